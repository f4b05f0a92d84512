"""Chat messages in order, with scored reply links, link trees and the state of each thread.

Order within a thread comes from one range partitioning of all rows by (thread, created_at, id), not from one task per
thread: a thread may fill many partitions. Windows then run within (thread, partition), and what a row needs from earlier
partitions is carried over through one summary row per thread and partition, for the threads that span several. Reply links
have all earlier rows for candidates: threads that span several blocks are compared block by block.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.session import cut

#: White space as Unicode counts it, zero-width characters and byte order marks, for Java's regular expressions.
BLANK_CLASS = r"[\s\p{Z}\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff]"
#: Spellings of the speakers, in lower case.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "system": "system", "tool": "tool"}
KEY = "thread_db_id"


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space, zero-width characters and byte order marks."""
    return text.isNull() | text.rlike(f"^{BLANK_CLASS}*$")


def speaker_of(role: Column) -> Column:
    """user, assistant, system or tool by any spelling; null if the speaker cannot be told."""
    plain = F.lower(F.regexp_replace(role, f"^{BLANK_CLASS}+|{BLANK_CLASS}+$", ""))
    names = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    return F.try_element_at(names, plain)


def merged(messages: DataFrame) -> DataFrame:
    """Rows equal in thread, role, content and created_at as one row with the least id, with speaker and blank.

    Rows without a thread belong to no conversation and are left out.
    """
    return (
        messages.where(F.col(KEY).isNotNull())
        .groupBy(KEY, "role", "content", "created_at")
        .agg(F.min("id").alias("id"))
        .select(KEY, "id", "content", "created_at", speaker_of(F.col("role")).alias("speaker"), is_blank(F.col("content")).alias("blank"))
    )


def in_order(rows: DataFrame) -> DataFrame:
    """The rows range-partitioned and sorted by (thread, created_at, id), with their partition as ``part``; materialised."""
    order = [KEY, "created_at", "id"]
    return cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def carried(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(thread, part, NAME...): of each value, the last non-null one of the thread in earlier partitions.

    ``values`` maps a name to an expression over a row. Only threads in more than one partition have rows here, so the
    frame has at most two rows for each partition.
    """
    at = F.struct("created_at", "id")
    last = [F.max_by(v, F.when(v.isNotNull(), at)).alias(n) for n, v in values.items()]
    spread = rows.groupBy(KEY, "part").agg(*last)
    many = Window.partitionBy(KEY)
    before = Window.partitionBy(KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spread.withColumn("parts", F.count("*").over(many))
        .where("parts > 1")
        .select(KEY, "part", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in values])
    )


def with_last(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The rows with, by name, the last non-null value of each expression over the earlier rows of the thread."""
    local = Window.partitionBy(KEY, "part").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = carried(rows, values).select(KEY, "part", *[F.col(n).alias(f"{n}_carried") for n in values])
    here = rows.select("*", *[F.last(v, ignorenulls=True).over(local).alias(n) for n, v in values.items()])
    joined = here.join(earlier, [KEY, "part"], "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(n), F.col(f"{n}_carried")).alias(n) for n in values])


WORD = re.compile(r"[a-z0-9äöüß_.\-]*[a-z0-9äöüß]|[一-鿿]")
#: Identifiers: with an underscore, dot or hyphen inside, or in camel case.
NAME = re.compile(r"\b(?:\w+[_.\-]\w[\w.\-]*|[A-Za-z]+[a-z][A-Z]\w*)\b")
#: Rows of a thread that one task compares with each other, or with as many later ones, and the number up to which that is done
#: one by one, not by an index. Neither changes a link.
BLOCK_ROWS, FEW_ROWS = 16384, 48
#: A question is linked to an earlier message only from this score on; below it opens a topic of its own.
FOLLOW_UP = 1.5
#: What the opening question of a turn has ahead of the other candidates, which share most of a turn's closeness in time.
TURN_BONUS = 0.25


class Message:
    """What scoring needs of a message; ``n``: its place in the thread, ``root``: the question its links lead to."""

    __slots__ = ("n", "id", "speaker", "at", "names", "words", "root")

    def __init__(self, n: int, id_: int, speaker: str, at: int, content: str):
        self.n, self.id, self.speaker, self.at = n, id_, speaker, at
        self.names, self.words = frozenset(NAME.findall(content)), frozenset(WORD.findall(content.lower()))
        self.root = id_ if speaker == "user" else None


def link_score(later: Message, candidate: Message) -> float:
    """How likely ``later`` answers or follows ``candidate``: closeness in time, shared names and lexical overlap, 0 to 3."""
    closeness = 1.0 / (1.0 + max((later.at - candidate.at) / 6e8, 0.0))
    overlap = len(later.words & candidate.words) / max(min(len(later.words), len(candidate.words)), 1)
    return closeness + (not later.names.isdisjoint(candidate.names)) + overlap


class Channel:
    """The candidates of one block of a thread in order: at first as messages, then by the places of each word and name."""

    def __init__(self):
        self.few: list[Message] | None = []
        self.keys: list[tuple[int, int, int | None]] = []
        self.question: int | None = None
        self.at, self.sizes, self.tools = array("q"), array("i"), array("b")
        self.words: dict[str, array] = {}
        self.names: dict[str, array] = {}

    def add(self, message: Message) -> None:
        if message.speaker == "system":
            return
        if message.speaker == "user":
            self.question = len(self.keys)
        self.keys.append((message.n, message.id, message.root))
        if self.few is None:
            self._index(len(self.keys) - 1, message)
        else:
            self.few.append(message)
            if len(self.few) > FEW_ROWS:
                for place, held in enumerate(self.few):
                    self._index(place, held)
                self.few = None

    def _index(self, place: int, message: Message) -> None:
        self.at.append(message.at)
        self.sizes.append(len(message.words))
        self.tools.append(message.speaker == "tool")
        for places, found in ((self.words, message.words), (self.names, message.names)):
            for term in found:
                places.setdefault(term, array("i")).append(place)

    def _scores(self, message: Message) -> np.ndarray:
        """``link_score`` of all candidates."""
        shared, named = np.zeros(len(self.at), np.int32), np.zeros(len(self.at))
        for term in message.words:
            if term in self.words:
                shared[np.frombuffer(self.words[term], np.int32)] += 1
        for term in message.names:
            if term in self.names:
                named[np.frombuffer(self.names[term], np.int32)] = 1.0
        closeness = 1.0 / (1.0 + np.maximum((message.at - np.frombuffer(self.at, np.int64)) / 6e8, 0.0))
        return closeness + named + shared / np.maximum(np.minimum(np.frombuffer(self.sizes, np.int32), len(message.words)), 1)

    def link(self, message: Message, opening: int | None) -> tuple[tuple[int, int, int | None] | None, float | None]:
        """Place, id and root of the likeliest parent, and its score; of equal scores the earlier one. System rows have none."""
        if message.speaker == "system" or not self.keys:
            return None, None
        asks = message.speaker == "user"
        opens = self.question if not asks and self.question is not None and self.keys[self.question][1] == opening else None
        if self.few is None:
            scores = self._scores(message)
            if asks:
                scores[np.frombuffer(self.tools, np.int8) == 1] = -np.inf
            if opens is not None:
                scores[opens] += TURN_BONUS
            best = int(scores.argmax())
            most = float(scores[best])
        else:
            best, most = 0, float("-inf")
            for place, candidate in enumerate(self.few):
                if asks and candidate.speaker == "tool":
                    continue
                score = link_score(message, candidate) + (TURN_BONUS if place == opens else 0.0)
                if score > most:
                    best, most = place, score
        return (self.keys[best], most) if most > float("-inf") else (None, None)


PASSED = [KEY, "part", "id", "speaker", "content", "created_at"]


def _linked(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Links the rows of sorted (thread, partition) runs within blocks; a row marked ``halo`` is the last question before the run."""
    place, channel, n, opening = None, Channel(), 0, None
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    for batch in batches:
        own, out = [], ([], [], [], [], [], [])
        columns = [batch[c].to_pylist() for c in (KEY, "part", "id", "speaker", "at", "content", "halo")]
        for thread, part, id_, speaker, at, content, halo in zip(*columns):
            if (thread, part) != place:
                place, n, opening = (thread, part), 0, None
            own.append(not halo)
            if halo:
                opening = id_
                continue
            if n % block_rows == 0:
                channel = Channel()
            message = Message(n, id_, speaker, at, content)
            parent, score = channel.link(message, opening)
            if speaker == "user":
                opening = id_
            elif parent is not None:
                message.root = parent[2]
            for column, value in zip(out, (n, parent and parent[0], parent and parent[1], score, message.root, opening)):
                column.append(value)
            channel.add(message)
            n += 1
        kept = pa.RecordBatch.from_arrays([batch[c] for c in PASSED], PASSED).filter(pa.array(own, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(out, types))], [*PASSED, "n", "reply_n", "reply_to", "link_score", "root_id", "turn_id"])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The likeliest parent in an earlier block for each row of a later one; input sorted by both, the earlier block's rows first."""
    place, channel = None, Channel()
    for batch in batches:
        out = ([], [], [], [], [])
        columns = [batch[c].to_pylist() for c in (KEY, "earlier", "later", "asking", "position", "id", "speaker", "at", "content", "turn_id")]
        for thread, earlier, later, asking, position, id_, speaker, at, content, turn in zip(*columns):
            if (thread, earlier, later) != place:
                place, channel = (thread, earlier, later), Channel()
            message = Message(position, id_, speaker, at, content)
            if not asking:
                channel.add(message)
                continue
            parent, score = channel.link(message, turn)
            if parent is not None:
                for column, value in zip(out, (thread, position, parent[0], parent[1], score)):
                    column.append(value)
        types = (batch.schema.field(KEY).type, pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [KEY, "position", "reply_n", "reply_to", "link_score"])


def _best_of_blocks(rows: DataFrame) -> DataFrame:
    """(KEY, position, reply_n, reply_to, link_score): the likeliest parent of a thread's rows among its blocks; input also has their own block's.

    Each pair of blocks is one piece of work for one task, so no task holds more than a block of candidates; the rows of a
    thread are sent once for each other block it has.
    """
    spark = rows.sparkSession
    blocks = rows.select(KEY, "block").distinct()
    pairs = blocks.select(KEY, F.col("block").alias("earlier")).join(blocks.select(KEY, F.col("block").alias("later")), KEY).where("earlier < later")
    told = rows.where("speaker <> 'system'").select(KEY, "block", "position", "id", "speaker", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "content", "turn_id")
    sides = [
        told.withColumnRenamed("block", side).join(pairs, [KEY, side]).select(KEY, "earlier", "later", F.lit(side == "later").alias("asking"), "position", "id", "speaker", "at", "content", "turn_id")
        for side in ("earlier", "later")
    ]
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)  # fixed, since AQE would join partitions that are small but slow
    sent = sides[0].unionByName(sides[1]).repartition(wide, KEY, "earlier", "later").sortWithinPartitions(KEY, "earlier", "later", "asking", "position")
    crossed = sent.mapInArrow(_crossed, f"{KEY} {rows.schema[KEY].dataType.simpleString()}, position long, reply_n long, reply_to long, link_score double")
    own = rows.where("link_score is not null").select(*crossed.columns)
    best = F.max(F.struct("link_score", (-F.col("reply_n")).alias("back"), "reply_to"))
    return crossed.unionByName(own).groupBy(KEY, "position").agg(best.alias("b")).select(KEY, "position", (-F.col("b.back")).alias("reply_n"), "b.reply_to", "b.link_score")


def _roots(rows: DataFrame) -> DataFrame:
    """(KEY, position, root_id) by pointer doubling; input (KEY, position, id, speaker, reply_n)."""
    asks = F.col("speaker") == "user"
    known = cut(rows.select(KEY, "position", F.when(~asks, F.col("reply_n")).alias("to"), F.when(asks, F.col("id")).alias("root_id")))
    while not known.where("to is not null").isEmpty():
        step = known.select(KEY, F.col("position").alias("to"), F.col("to").alias("next"), F.col("root_id").alias("met"))
        known = cut(known.join(step, [KEY, "to"], "left").select(KEY, "position", F.col("next").alias("to"), F.coalesce("root_id", "met").alias("root_id")))
    return known.select(KEY, "position", "root_id")


def reply_links(ordered: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each message with ``reply_to``, ``link_score``, ``root_id``, ``turn_id`` and ``position`` (from 0); input from ``in_order``.

    Candidates for a message are all rows before it in its thread but system ones; for a question tools' rows are none. The
    candidate of the highest ``link_score`` is the parent, on equal ones the earlier; a question below ``FOLLOW_UP`` for all
    has none, nor have system rows. ``root_id`` is the first question met when links are followed, its own id for a question;
    null where they lead to none. ``turn_id`` is the last question up to the message, null before the first. One pass over
    rows sorted by (thread, created_at, id) links them within blocks, that is up to ``block_rows`` rows of a thread in one
    partition; threads of several blocks are then compared block by block, so the work for one grows with its square.
    """
    own = ordered.withColumn("halo", F.lit(False))
    opening = carried(ordered, {"opening": F.when(F.col("speaker") == "user", F.col("id"))}).where("opening is not null")
    halo = opening.select(KEY, "part", F.col("opening").alias("id"), F.lit(True).alias("halo"))
    rows = own.unionByName(halo, allowMissingColumns=True).withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")))
    sent = rows.repartition(KEY, "part").sortWithinPartitions(KEY, "part", F.desc("halo"), "created_at", "id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.select(*PASSED).schema)
    links = cut(sent.select(*PASSED, "at", "halo").mapInArrow(lambda batches: _linked(batches, block_rows), f"{kinds}, n long, reply_n long, reply_to long, link_score double, root_id long, turn_id long"))
    sizes = links.groupBy(KEY, "part").agg(F.count("*").alias("rows"))
    many, earlier = Window.partitionBy(KEY), Window.partitionBy(KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset")
    several = cut(sizes.select(KEY, "part", offset, F.sum(F.ceil(F.col("rows") / block_rows)).over(many).alias("blocks")).where("blocks > 1").drop("blocks"))
    if several.isEmpty():
        told = links.withColumn("position", F.col("n"))
    else:
        block = F.col("part").cast("long") * 2**32 + F.floor(F.col("n") / block_rows)
        long_ = cut(links.join(several, [KEY, "part"]).withColumn("position", F.col("n") + F.col("offset")).withColumn("block", block).withColumn("reply_n", F.col("reply_n") + F.col("offset")))
        best = cut(_best_of_blocks(long_))
        place = long_.select(KEY, "position", "part", "n", "id", "speaker").join(best, [KEY, "position"], "left")
        new = place.join(_roots(place), [KEY, "position"]).select(KEY, "part", "n", F.struct("position", "reply_to", "link_score", "root_id").alias("new"))
        chosen = lambda c: F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)).alias(c)
        told = links.withColumn("position", F.col("n")).join(new, [KEY, "part", "n"], "left").select(
            KEY, "id", "speaker", "content", "created_at", "turn_id", *[chosen(c) for c in ("position", "reply_to", "link_score", "root_id")]
        )
    linked = (F.col("speaker") != "user") | (F.col("link_score") >= FOLLOW_UP)
    return told.select(
        KEY, F.col("position").cast("long").alias("position"), "id", "speaker", "content", "created_at",
        F.when(linked, F.col("reply_to")).alias("reply_to"), F.when(linked, F.round("link_score", 6)).alias("link_score"), "root_id", "turn_id",
    )


def thread_faults(threads: DataFrame, merged_rows: DataFrame, links: DataFrame, confirm: bool = True) -> DataFrame:
    """(thread_db_id, reason) of the threads that hold no sound conversation, by the first reason that applies.

    ``empty``: no row with content; ``broken``: a row without created_at or whose speaker cannot be told, or the first row
    apart from system and tool is not the user's; ``no_reply``: a question whose link tree holds no answer of its turn and,
    with ``confirm``, whose turn holds no answer at all. ``merged_rows`` has all rows with content, ``links`` the links of
    those with a time and a known speaker. A thread with none but system and tool rows is sound. Every message of a thread
    without a row in ``threads`` is ignored.
    """
    talk = F.col("speaker").isin("user", "assistant")
    facts = merged_rows.groupBy(KEY).agg(
        F.count("*").alias("rows"),
        F.max((F.col("created_at").isNull() | F.col("speaker").isNull()).cast("int")).alias("bad"),
        F.min(F.when(talk & F.col("created_at").isNotNull(), F.struct("created_at", "id", "speaker")))["speaker"].alias("opener"),
    )
    answers = F.col("speaker") == "assistant"
    trees = links.where(F.col("turn_id").isNotNull()).groupBy(KEY, "turn_id").agg(
        F.max((answers & (F.col("root_id") == F.col("turn_id"))).cast("int")).alias("linked"), F.max(answers.cast("int")).alias("present")
    )
    open_ends = trees.groupBy(KEY).agg(F.max((F.coalesce("linked", F.lit(0)) == 0) & ((F.col("present") == 0) | F.lit(not confirm))).alias("unanswered"))
    reason = (
        F.when(F.col("rows").isNull(), "empty")
        .when((F.col("bad") == 1) | (F.col("opener") != "user"), "broken")
        .when(F.col("unanswered"), "no_reply")
    )
    ids = threads.select(F.col("id").alias(KEY)).dropna().distinct()
    return ids.join(facts, KEY, "left").join(open_ends, KEY, "left").select(KEY, reason.alias("reason")).where("reason is not null")


def conversations(threads: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages of sound threads with position, speaker and links; faults of the other threads)."""
    rows = merged(messages).where(~F.col("blank")).drop("blank")
    known = F.col("created_at").isNotNull() & F.col("speaker").isNotNull()
    links = cut(reply_links(in_order(rows.where(known))))
    faults = cut(thread_faults(threads, rows, links))
    sound = threads.select(F.col("id").alias(KEY)).dropna().distinct().join(faults, KEY, "left_anti")
    return links.join(sound, KEY, "left_semi"), faults
