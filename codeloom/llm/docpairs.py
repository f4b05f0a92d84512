"""Functions paired with their documentation, without those whose documentation is empty or tells nothing.

Everything is an expression in the JVM: comment marks, tags, stamps, stubs, licences and dead code are removed from a
docstring step by step, and what is left must hold a word that is neither generic nor part of the function's own name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.messages import is_blank
from codeloom.session import cut

KINDS = ("method", "constructor")

#: Removed in this order (Java regular expressions, replacement).
STEPS = [
    (r"\r\n?", "\n"),
    (r"(?s)<!--|-->", " "),
    (r"</?[A-Za-z][^<>\n]*>|&nbsp;", " "),
    (r"(?m)\*+/\s*$", ""),
    (r"(?m)^[ \t]*(?:/\*+!?|\*+/?|//+[/!]*|#+|--+|\"\"\"|''')[ \t]?", ""),
    (r"\{@(?:link|linkplain|code|literal|value)\s+([^{}]*)\}", "$1"),
    (r"(?i)\{?@inherit_?doc\}?|\(non-javadoc\)", " "),
    (r"(?m)^[ \t]*@\w+.*(?:\n(?![ \t]*(?:@|$)).*)*", ""),
    (r"(?m)^[ \t]*[:\\](?:param|return|returns|throws|raises|type|rtype)\b.*$", ""),
    (r"(?m)^.*[;{}][ \t]*(?://.*)?$", ""),
    (r"(?m)^[ \t]*(?:return|throw|var|final|int|long|double|boolean|String|val|let|const)[ \t]+[\w.<>]+[ \t]*(?:=|\().*$", ""),
    (r"(?m)^[ \t]*(?:if|for|while|switch|catch)[ \t]*\(.*\)[ \t]*$", ""),
    (r"(?i)\b(?:todo|fixme|xxx|hack|tbd)\b[^.。!?！？\n]*[.。!?！？]?", " "),
    (r"(?i)\b(?:auto(?:matically)?[- ]?generated|generated|created|written|added|erzeugt|generiert|erstellt)\s+(?:automatically\s+)?(?:by|from|with|on|using|via|von|durch|mit|am)\b[^.。\n]*[.。]?", " "),
    (r"(?i)\bauto(?:matically)?[- ]?generated\b[^.。\n]*[.。]?|\bautomatisch (?:erzeugt|generiert|erstellt)\b[^.。\n]*[.。]?|[^。\n]*自动生成[^。\n]*。?|由[^。\n]{1,30}(?:生成|创建)。?", " "),
    (r"(?im)^[ \t]*(?:author|date|since|version|created|modified|last modified|autor|datum|stand|作者|日期|版本|创建时间)[ \t]*[:：=].*$", ""),
    (r"(?m)^[ \t]*(?:\d{1,4}[-./]){2}\d{1,4}[ \t]*$", ""),
]
LICENCE = (
    r"(?i)licen[sc]ed under|licen[sc]ed to the|all rights reserved|\bcopyright\b|\(c\) ?(?:19|20)\d\d|©|spdx-|permission is hereby granted|redistribution and use"
    r"|apache license|mit license|gnu (?:lesser |affero )?general public|without warrant|alle rechte vorbehalten|lizenziert|版权所有|保留所有权利|许可证"
)
#: Words that tell nothing by themselves.
GENERIC = frozenset(
    """a an the this that these its it of for to and or is are be as in on with by from at into via
    method methods function functions procedure constructor constructors ctor class default empty simple basic new create creates created
    construct constructs instance object objects return returns returned result results value values given passed parameter parameters param
    params argument arguments arg args getter setter accessor mutator helper utility does do performs perform executes execute implementation
    implements impl override overrides overridden see description documentation doc docs comment comments no none n na nil null undefined
    missing here stub placeholder ditto same above below tostring
    die der das den dem des ein eine einen einer dies diese dieser und oder ist von für zu zum zur im am mit methode funktion konstruktor klasse
    standardkonstruktor gibt zurück liefert setzt holt erzeugt erstellt neue neuen neues neuer wert ergebnis parameter keine kein beschreibung
    siehe oben dokumentation kommentar""".split()
)
GENERIC_HAN = r"构造函数|构造方法|构造器|默认|无参|方法|函数|该|此|这个|这是|一个|的|新|创建|返回值?|结果|参数|待补充|待完善|待办|暂无|说明|描述|注释|文档|同上|略|无|类|获取|设置|实现|用于|用来"


def cleaned(docstring: Column) -> Column:
    """A docstring without comment marks, tags, stamps, stubs, to-do marks and code, on one line."""
    text = reduce(lambda c, step: F.regexp_replace(c, *step), STEPS, docstring)
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}​﻿]+", " "))


def _split_names(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2"))


def is_informative(docstring: Column, name: Column) -> Column:
    """Whether a docstring tells something beyond the function's name; False for null."""
    text = _split_names(cleaned(docstring))
    words = F.regexp_extract_all(F.regexp_replace(text, GENERIC_HAN, " "), F.lit(r"[a-z0-9äöüßéèà]+|[㐀-鿿]+"), F.lit(0))
    own = F.regexp_extract_all(_split_names(F.coalesce(name, F.lit(""))), F.lit(r"[a-z0-9äöüß]+|[㐀-鿿]+"), F.lit(0))
    generic = F.array(*[F.lit(w) for w in sorted(GENERIC)])

    def is_own(word: Column) -> Column:
        return F.exists(own, lambda part: ((F.length(part) >= 2) & word.startswith(part) & (F.length(word) - F.length(part) <= 3)) | (word == part))

    told = F.exists(words, lambda word: ~F.array_contains(generic, word) & ~is_own(word) & ~word.rlike(r"^\d+$"))
    return F.coalesce(told & ~docstring.rlike(LICENCE), F.lit(False))


def normal_signature(signature: Column) -> Column:
    """The parameter types of a signature, without modifiers, annotations, generics' blanks, names and what follows the list."""
    inner = F.regexp_extract(F.regexp_replace(signature, r"\s+", " "), r"\((.*)\)", 1)
    flat = F.regexp_replace(F.regexp_replace(inner, r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", ""), r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "")
    return F.array_join(F.transform(F.split(flat, ","), lambda p: F.regexp_extract(F.trim(p), r"^(\S+)", 1)), ",")


def functions_of(symbols: DataFrame) -> DataFrame:
    """The latest row (by updated_at) of every method and constructor, with the key of its overload and whether its docstring tells something.

    Rows without an id are left out; null or blank signatures stay, as ``has_signature`` false.
    """
    latest = (
        symbols.where(F.col("kind").isin(*KINDS) & F.col("id").isNotNull())
        .select("id", "project_id", "file_id", "kind", "name", "qualified_name", "signature", "docstring", "updated_at")
        .groupBy("id")
        .agg(F.max_by(F.struct("project_id", "file_id", "kind", "name", "qualified_name", "signature", "docstring"), F.struct("updated_at", "signature", "docstring")).alias("r"))
    )
    return latest.select(F.col("id").alias("symbol_id"), "r.*").select(
        "*", (~is_blank(F.col("signature"))).alias("has_signature"), is_informative(F.col("docstring"), F.col("name")).alias("told"),
        normal_signature(F.coalesce("signature", F.lit(""))).alias("overload"),
    )


def joined(symbols: DataFrame) -> DataFrame:
    """Every function with a signature beside the declaration that documents it: the table that ``pairs`` filters.

    (symbol_id, kind, name, qualified_name, signature, docstring, described_by, told). A function's own docstring goes first if
    it tells something, else that of a declaration of the same qualified name and parameter types elsewhere in its project:
    of several the first that tells something, by id. Declarations are reduced to one a key before the join, so no key multiplies
    rows; whether a docstring tells something is found out once, before that.
    """
    all_ = cut(functions_of(symbols).where("has_signature").drop("has_signature"))
    key = ["project_id", "qualified_name", "overload"]
    declared = all_.dropna(subset=[*key, "docstring"]).groupBy(*key).agg(F.min_by(F.struct("symbol_id", "docstring", "told"), F.struct(~F.col("told"), "symbol_id")).alias("declared"))
    both = all_.join(declared, key, "left")
    own = F.col("told") | F.col("declared").isNull()
    return both.select(
        "symbol_id", "kind", "name", "qualified_name", "signature", F.when(own, F.col("docstring")).otherwise(F.col("declared.docstring")).alias("docstring"),
        F.when(own, F.col("symbol_id")).otherwise(F.col("declared.symbol_id")).alias("described_by"), F.when(own, F.col("told")).otherwise(F.col("declared.told")).alias("told"),
    )


def pairs(symbols: DataFrame) -> DataFrame:
    """(symbol_id, kind, qualified_name, signature, description, described_by): the joined table without what is undocumented or trivial.

    ``described_by`` is the symbol that the description was written for, the function itself or a declaration of it.
    """
    return joined(symbols).where("told").select("symbol_id", "kind", "qualified_name", "signature", cleaned(F.col("docstring")).alias("description"), "described_by")
