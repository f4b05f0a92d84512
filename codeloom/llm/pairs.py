"""Question and answer pairs whose answer is defective, with the type of defect.

Empty, copied, refusing and foreign-language answers are told from the pair alone. Cut-off answers are told from all
answers together: identifiers and numbers are masked, the answers' sentences are sorted, and each sentence is compared with
the ones that follow it in that order. A last sentence that is a shortened version of many others, or that hardly ever ends
an answer, was cut off. The sort is a range partitioning of the distinct masked sentences with their counts; where a run of
extensions crosses partitions, the few sentences still open at a partition's end are compared with the next ones for as long as those
begin with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from codeloom.llm import messages as chat
from codeloom.session import cut

#: A sentence that ends answers in less than this share of its occurrences and extensions is cut off.
END_SHARE = 0.4
#: ... as is one whose last word is no identifier where, after the same stem, less than this share of all ends in any word so.
STUMP_SHARE = 0.028
#: An answer length of at least so many characters is a limit if this share of all unfinished answers have exactly it, and so many times its neighbours' mean.
SPIKE_SIZE, SPIKE_SHARE, SPIKE_TIMES = 80, 0.01, 8.0

IDENTIFIER = re.compile(r"`[^`\n]{1,80}`|(?<![\w])(?:\d+\.)+\d+(?![\w])|[A-Za-z]\w*(?:[._:/\-]+\w+)+|[A-Za-z]\w*_\w*|\b[A-Za-z]+[a-z][A-Z]\w*|\b[A-Z]{2,}-[\d\-]+")
NUMBER = re.compile(r"\d+(?:[.,:\-]\d+)*")
FENCE, COMMENT = re.compile(r"```.*?```", re.S), re.compile(r"<!--.*?-->", re.S)
CLOSING = re.compile(r"[.!?。！？;；\"'”)\]*]+$")
HAN = re.compile(r"[㐀-鿿]")
LETTER_RUN = re.compile(r"[^\W_]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
BLANK = re.compile(r"[\s᠎​-‍⁠﻿\x1c-\x1f]+")
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&nbsp;|&#?\w+;|```\w*|[`*_~#>|\[\]{}()\"'“”‘’<>=+\-–—….,;:!?/\\。，：；！？「」•·]")

#: Fillers that stand for no content, folded.
FILLERS = frozenset(
    "n a|na|none|null|nil|undefined|nan|no content|no answer|no response|no reply|no text|empty|blank|tbd|todo|to do|placeholder|"
    "lorem ipsum|keine|leer|kein inhalt|keine antwort|keine angabe|ohne inhalt|无|暂无|空|无内容|暂无内容|"
    "暂无回答|待补充|没有内容|略".split("|")
)
FILLER_STARTS = re.compile("|".join(re.escape(w) for w in sorted({f.split()[0] for f in FILLERS}, key=len, reverse=True)))
#: What a copied question may be wrapped in, folded.
LEADS = re.compile(
    r"^(?:you asked|you asked me|your question|your question was|the question is|the question was|question|q|frage|deine frage|ihre frage|du fragst|"
    r"du hast gefragt|sie fragen|你问的是|您问的是|你问|您问|问题|问|你的问题是)+$"
)
GREETING = re.compile(r"^(?:hi|hello|hey|next|hallo|guten tag|noch eine frage|one more question|another question|你好|您好|再问一下|请问)+")

#: Words by language, each told from the other languages' lists.
WORDS = {
    "en": "the is are was were of and to it its this that these there which what who why how where when does do did can cannot not with from for be been has have will would should may all any only no yes please you your i my we at an like after before then than more most once twice at by into because whenever while",
    "de": "der die das und nicht ist sind wird werden wurde von zu zum zur auf ein eine einen einer eines den dem des wie kann was welche welcher welches wenn weil dass ich du sie wir mit für bei nach nur auch dann danach dabei darüber dies diese dieser dort nein ja bitte leider muss darf möchte geschieht keine nichts noch etwas es im am beim kurz zweimal schreibt gehören schritte erhöhe",
    "fr": "le la les un une des du et est sont dans pour par pas ne que qui quoi ce cette ces il elle nous vous ils avec sur au aux en car mais ensuite puis après avant seule seul autres autre tout tous toute pendant non oui l'appel fois attend reste font lire écrit classe",
    "es": "el los las una unos y es está son en para por con se que del al lo pero más como su sus este esta no sí después luego entonces solo también cada hasta desde sobre mensaje llamada clase escribe tabla veces porque durante",
    "it": "il lo gli una e è sono di che non per con si nel nella del della dei alla dopo poi solo anche come questo questa viene volte messaggio chiamata classe scrive tabella perché durante altre resta",
    "pt": "o os as um uma e é são em para por com se que do da dos das não mais como seu sua este esta depois então apenas também cada até desde sobre mensagem chamada classe escreve tabela vezes porque durante",
    "nl": "het een en is zijn van niet dat die dit met voor op aan naar door maar ook dan daarna alleen wordt worden heeft hebben geen nog bij uit keer bericht klasse schrijft tabel omdat tijdens",
    "pl": "jest nie się na do z w i a że to po tylko przez dla od jak ale oraz potem razy wiadomość wywołanie klasa zapisuje tabeli trafia powtarzane ponieważ podczas gdy",
    "sv": "och är det att en ett som på av inte med för till den sedan bara gånger meddelandet klassen skriver tabellen eftersom under anropet",
    "cs": "je se na v a že to po jen pro od jak ale pak krát zpráva volání třída zapisuje tabulky protože během",
    "tr": "ve bir bu için ile de da sonra sadece kez mesaj sınıfı yazar tablosuna çünkü çağrı",
}
OF_WORD: dict[str, list[str]] = {}
for _language, _words in WORDS.items():
    for _word in set(_words.split()):
        OF_WORD.setdefault(_word, []).append(_language)
ASKED = {
    "en": re.compile(r"\b(?:in|into|auf|en) (?:english|englisch|anglais)\b|用?(?:英文|英语)", re.I),
    "de": re.compile(r"\b(?:in|into|auf|en) (?:german|deutsch|allemand)\b|用?(?:德文|德语)", re.I),
    "zh": re.compile(r"\b(?:in|into|auf|en) (?:chinese|mandarin|chinesisch|chinois)\b|用?(?:中文|汉语|华语)", re.I),
    "fr": re.compile(r"\b(?:in|into|auf|en) (?:french|französisch|français)\b|用?(?:法文|法语)", re.I),
    "es": re.compile(r"\b(?:in|into|auf|en) (?:spanish|spanisch|español)\b|用?西班牙语", re.I),
    "it": re.compile(r"\b(?:in|into|auf|en) (?:italian|italienisch)\b|用?意大利语", re.I),
    "pl": re.compile(r"\b(?:in|into|auf|en) (?:polish|polnisch)\b|用?波兰语", re.I),
    "ja": re.compile(r"\b(?:in|into|auf|en) (?:japanese|japanisch)\b|用?(?:日文|日语)", re.I),
}

#: Sentences that decline, by language; each is about the speaker's own refusal, not about software.
DECLINES = re.compile(
    r"""\bi(?:\s+am|'m)?\s+(?:really\s+|simply\s+)?(?:can(?:no|')t|can\s+not|won't|will\s+not|would\s+not|wouldn't|do\s+not|don't|am\s+not|'m\s+not|not)\s+(?:be\s+)?(?:able\s+to\s+|going\s+to\s+|allowed\s+to\s+|permitted\s+to\s+|in\s+a\s+position\s+to\s+|willing\s+to\s+|comfortable\s+|feel\s+comfortable\s+|want\s+to\s+|wish\s+to\s+|authori[sz]ed\s+to\s+)*(?:help|assist|answer|provid|discuss|comment|talk|shar|disclos|giv|respond|say\s+anything|go\s+into|address|comply|fulfil|do\s+that|support|offer|reveal|speak|engag|tell)
    |\b(?:something|anything|that|this|which)\s+i\s+(?:can(?:no|')t|can\s+not|won't|will\s+not|am\s+not|may\s+not)\b
    |\bi(?:'m|\s+am)\s+(?:unable|not\s+able|not\s+allowed|not\s+permitted|not\s+in\s+a\s+position)\b
    |\bi\s+(?:would|'d)\s+(?:rather|prefer)\s+not|\bi'd\s+(?:rather|prefer)\s+not|\bi\s+(?:have\s+to|must|need\s+to)\s+(?:decline|refuse|pass)
    |\bi\s+(?:decline|refuse)\b|\bnot\s+(?:something\s+)?i(?:'m|\s+am)\s+(?:willing|able|allowed|prepared|comfortable)
    |\bagainst\s+my\s+(?:guideline|polic|rule|instruction|principle)|\bmy\s+(?:instructions|guidelines|policies|rules)\s+(?:keep|prevent|forbid|do\s+not|don't|prohibit|stop)
    |\bas\s+an?\s+(?:ai\b|large\s+)?\s*(?:language\s+model|ai|assistant)|\bi\s+hold\s+no\s+opinion|\bi\s+have\s+no\s+opinion
    |\blet'?s\s+(?:talk|speak|chat)\s+about\s+something|\bchange\s+the\s+(?:subject|topic)|\bfind\s+someone\s+else|\bask\s+someone\s+else
    |\b(?:outside|beyond)\s+(?:of\s+)?(?:what|the\s+scope\s+of\s+what)\s+i\b|\bthis\s+(?:request|question|topic)\s+(?:falls|is|lies)\s+(?:outside|beyond|not\s+something|off)
    |\boff[\s-]+limits\b.*\b(?:me|us)\b|\b(?:topic|subject|matter|question)\s+is\s+(?:off[\s-]+limits|closed\s+to\s+me|taboo|confidential)|\bnot\s+at\s+liberty|\bnot\s+for\s+me\s+to\b|\bi\s+(?:must|have\s+to|prefer\s+to)\s+stay\s+(?:out|silent)|\bi(?:'m|\s+am)\s+not\s+the\s+right\b
    |\bthema\b.*\b(?:tabu|gesperrt)\b|\b(?:dazu|hierzu|darüber)\s+(?:sage|äußere|gebe|schweige)\s+ich\b|\bsteht\s+mir\s+nicht\s+zu|\bdafür\s+bin\s+ich\s+nicht\s+zuständig
    |不予置评|无可奉告|恕(?:不|难|我)|不便(?:透露|回答|讨论)|不在我(?:的)?(?:权限|范围|职责)|不属于我
    |^\W*(?:(?:i'm\s+)?(?:sorry|afraid)\W+)?(?:but\s+|that\s+)?(?:(?:we|i)\s+(?:are\s+|am\s+)?)?(?:can(?:no|')t|can\s+not|won't|unable\s+to|not\s+able\s+to|have\s+to\s+decline\s+to|must\s+decline\s+to)\s+(?:help|assist|answer|comply|discuss|advise|support|do|give|provide|share|respond)\b
    |\b(?:would\s+not|wouldn't|is\s+not|isn't)\s+(?:be\s+)?appropriate\s+for\s+(?:me|us)\b|\binappropriate\s+for\s+(?:me|us)\b|\bi\s+(?:should\s+not|shouldn't|could\s+not|couldn't)\s+(?:possibly\s+)?(?:help|assist|answer|comment|discuss|share|say|tell|advise)
    |\bmy\s+(?:programming|training|configuration|safety\s+\w+)\s+(?:does\s+not|doesn't|won't|prevents?|forbids?|stops?)
    |\b(?:sharing|discussing|saying|disclosing)\s+(?:anything|details|information)\b.*\bis\s+not\b|\bno\s+comment\s+(?:on|from)\b
    |\b(?:dabei|damit|hierbei|da|dir|ihnen|hier)\s+kann\s+ich\b.*\bnicht\b|\bkann\s+ich\s+(?:\w+\s+){0,4}?nicht\s+(?:helfen|beantworten|weiterhelfen|sagen|dienen|geben)|\bich\s+kann\b.*\b(?:nicht|keine?)\b.*\b(?:helfen|beantworten|sagen|geben|machen)
    |\bmuss\s+ich\s+(?:leider\s+)?ablehnen|\bich\s+muss\b.*\bablehnen|\bich\s+(?:lehne|verweigere)\b|\bdarf\s+ich\s+(?:leider\s+)?(?:nicht|keine|nichts)|\bich\s+darf\b.*\b(?:nicht|keine|nichts)\b
    |\bmöchte\s+ich\s+(?:lieber\s+|mich\s+)?nicht|\bich\s+möchte\b.*\bnicht\b|\baußerhalb\s+dessen|\bals\s+(?:sprachmodell|assistent|ki)\b|\bkeine\s+(?:auskunft|angaben|auskunft)\s+(?:geben|machen|erteilen)|\bwenden\s+sie\s+sich\s+(?:damit|bitte)|\bwende\s+dich\s+(?:damit|bitte)|\bsprechen\s+wir\s+(?:lieber\s+)?über\s+etwas|\bmeine\s+(?:anweisungen|richtlinien|vorgaben)|\bverstößt\s+gegen\s+meine|\bkeine\s+meinung
    |我(?:很抱歉|暂时|实在|并|也|是|目前)*(?:无法|不能|不便|不方便|没办法|没有办法|没法|不愿|不想|不会|不应|必须拒绝|只能拒绝|不得不拒绝|拒绝)
    |作为(?:一个|一名)?(?:助手|语言模型|ai|人工智能)|这类(?:请求|问题)(?:不被允许|不允许|我)|超出了?(?:我|可以|允许)|我的(?:规则|准则|指令|指南)|换个话题|聊点别的|请另请高明|没有(?:任何)?意见|我没有权限|违反了?我""",
    re.I | re.X | re.S,
)
#: Courtesies around a refusal that answer nothing.
COURTESY = re.compile(
    r"""^\W*(?:(?:i'm|i\s+am)\s+(?:very\s+|so\s+)?(?:sorry|afraid)|sorry|apologies|my\s+apologies|unfortunately|thanks?\b.*|thank\s+you.*|leider(?:\s+gilt)?|es\s+tut\s+mir\s+leid|entschuldig\w*|verzeihung|抱歉|很抱歉|不好意思|很遗憾|对不起)\W*$
    |\bi\s+hope\s+you\s+(?:understand|don't\s+mind)|\bplease\s+(?:ask|contact|consult|reach\s+out|speak|talk|refer|check\s+with|try)\b|\bfeel\s+free\b|\bis\s+there\s+anything\s+else|\banything\s+else\b|\blet\s+me\s+know|\bhappy\s+to\s+help\s+with|\bthank\s+you\s+for\s+(?:your\s+)?understanding|\bask\s+me\s+(?:about|something)
    |\bich\s+bitte\s+um|\bgibt\s+es\s+sonst|\bvielen\s+dank|\bdanke\b|\bkann\s+ich\s+sonst|\bbitte\s+(?:wende|frage|kontaktier)|\bgern\w*\s+helfe|\b(?:hoffe|bitte)\b.*\bverständnis
    |请(?:您|你)?(?:联系|咨询|询问|谅解|理解|见谅|找)|(?:您|你)?还有(?:其他|别的|什么)|希望(?:您|你).*理解|感谢|有其他问题|敬请|欢迎.*问""",
    re.I | re.X | re.S,
)
#: Words after which no sentence ends.
HANGING = frozenset(
    "and or but if because the a an of in to for with by from on at as that which when while its their our your my is are was were be been has have had will would can could should "
    "unless although though whereas except may must not only until than then so also into over about before after during without within between per each every this these those remaining following who whose where "
    "und oder aber wenn weil dass der die das den dem des ein eine einen einem einer im in am an auf für mit von vom zu zum zur bei beim nach nicht nur auch als wie sobald damit durch über unter vor danach dann sowie sondern sofern falls während obwohl außer ist sind wird werden wurde".split()
)
#: ... of which these do end sentences with a separated verb or an adverb, so that alone they prove nothing.
WEAK = frozenset("an auf ab vor nach zu then also is are was be by on in over not once danach dann nicht auch".split())
HANGING_HAN = re.compile(r"(?:因为|所以|但是|但|而且|并且|然后|然后由|如果|只有|以及|或者|和|与|当|的|把|被|由|向|从|对|在|之后|除非|另外|例如|比如|其中|不过|而|则|接着|同时|直到)$")
TAILS = re.compile(r"(?:\bbut only if|\bbecause the|\bfor example,? in|\bthe remaining|\bduring the|\band then|\bund danach|\bund dann|,? weil|\bsodass|\bzum beispiel,? (?:in|bei|im)|\bdie übrigen|\bwhich is why(?: \S+){0,2}|\bweshalb(?: \S+)?)$", re.I)
TERMINATED = re.compile(r"[.!?。！？…][\"'”’)\]）」*_]*$")
MASK = "□"
#: Between sentences and lines; also where a sentence follows an identifier or bracket without any mark.
SPLIT = re.compile(rf"(?<=[.!?;:])[\"')\]]*\s+|(?<=[。！？；])|[\r\n]+|(?<=[){MASK}]) (?=[A-Z][a-zäöü]* )|(?<=\)) (?={MASK} )")


def fold(text: str) -> str:
    """Letters, digits and Han characters in lower case, other runs as single blanks."""
    return " ".join(LETTER_RUN.findall(text.lower()))


SCRIPTS = [(re.compile(r), name) for r, name in ((r"[가-힯]", "ko"), (r"[Ѐ-ӿ]", "ru"), (r"[؀-ۿ]", "ar"), (r"[Ͱ-Ͽ]", "el"))]
KANA, EAST = re.compile(r"[぀-ヿ]"), re.compile(r"[぀-鿿]")
LETTERS = [(name, frozenset(letters)) for name, letters in (("de", "äöüß"), ("fr", "èêçàùœé"), ("pl", "łśćąężź"), ("es", "ñ¿¡"), ("sv", "å"), ("cs", "řěů"), ("tr", "ğış"), ("pt", "ãõ"))]


def language(text: str) -> str | None:
    """The language that a text's prose shows: by script, else by function words; None where it shows too little."""
    return prose_language(IDENTIFIER.sub(" ", FENCE.sub(" ", text)))


def prose_language(prose: str) -> str | None:
    """``language`` of a text without code and identifiers."""
    han = 0
    if not prose.isascii():
        kana, han = len(KANA.findall(prose)), len(HAN.findall(prose))
        if kana >= 2 and kana * 4 >= han:
            return "ja"
        for script, name in SCRIPTS:
            if len(script.findall(prose)) >= 6:
                return name
        prose = EAST.sub(" ", prose)
    lowered = prose.lower().replace("’", "'")
    words = WORD.findall(lowered)
    if han >= 2 and han >= len(words):
        return "zh"
    score: dict[str, float] = {}
    for word in words:
        for name in OF_WORD.get(word, ()):
            score[name] = score.get(name, 0) + 1 / len(OF_WORD[word])
    if not lowered.isascii():
        used = set("".join(words))
        for name, letters in LETTERS:
            if used & letters:
                score[name] = score.get(name, 0) + 0.75
    if not score:
        return None
    best = max(score, key=score.get)
    rest = max([v for k, v in score.items() if k != best], default=0)
    return best if score[best] >= 1 and score[best] > rest else None


def is_empty(text: str | None) -> bool:
    """Blank, or only a filler or markup without content."""
    if text is None:
        return True
    bare = BLANK.sub(" ", MARKUP.sub(" ", COMMENT.sub(" ", text) if "<!--" in text else text)).strip()
    if not bare:
        return True
    return any((first := LETTER_RUN.search(t)) and FILLER_STARTS.match(first[0].lower()) and fold(t) in FILLERS for t in (bare, text))


def is_copy(question: str, answer: str) -> bool:
    """Only gives the question back: once or more, quoted, introduced, or without its greeting, and nothing else."""
    asked, given = fold(question), fold(answer)
    if not asked or not given:
        return False
    bare = GREETING.sub("", asked).strip() or asked
    rest = given
    for form in (asked, bare):
        if len(form) >= 4:
            rest = rest.replace(form, " ")
    if rest != given:
        rest = GREETING.sub("", " ".join(rest.split())).strip()
        return not rest or bool(LEADS.match(rest.strip())) or bool(LEADS.match(GREETING.sub("", rest).strip()))
    return len(given) >= 8 and given in asked and len(given) >= 0.7 * len(bare)


def sentences_of(text: str) -> list[str]:
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|[\r\n]+", text)) if s]


def is_refusal(answer: str) -> bool:
    """Declines to answer and answers nothing: a declining sentence, and apart from it nothing but courtesies."""
    if "```" in answer:
        return False
    declined = False
    for part in sentences_of(answer):
        if re.match(r"i can(?:'|no)?t say more than\b", part, re.I):
            return False
        if DECLINES.search(part):
            declined = True
        elif not COURTESY.search(part):
            return False
    return declined


#: Parts of the languages' names, one of which stands in every text that ``ASKED`` matches.
LANGUAGE_NAMES = ("engl", "angl", "英", "german", "deutsch", "allemand", "德", "chin", "mandarin", "中文", "汉语", "华语", "french", "franz", "fran", "法", "span", "español", "西班牙", "ital", "意大利", "polish", "polnisch", "波兰", "japan", "日文", "日语")


def is_foreign(question: str, answer: str, answer_prose: str | None = None) -> bool:
    """In another language than the question's, unless the question asks for that one."""
    lowered = question.lower()
    asked = [name for name, pattern in ASKED.items() if pattern.search(question)] if any(n in lowered for n in LANGUAGE_NAMES) else []
    plain = question
    for name in asked:
        plain = re.sub(r"(?:please (?:answer|reply|respond|write)|bitte|请)[^.!?。！？]*$", " ", plain.rstrip(" .!?。！？"), flags=re.I)
    mine = language(answer) if answer_prose is None else prose_language(answer_prose)
    if mine is None or mine in asked:
        return False
    theirs = language(plain)
    return theirs is not None and mine != theirs


def masked(text: str) -> str:
    """Identifiers and numbers masked, complete code blocks as one mask of their own line."""
    return NUMBER.sub("#", IDENTIFIER.sub(MASK, FENCE.sub(f"\n{MASK}{MASK}\n", text) if "```" in text else text))


def units(text: str, plain: str | None = None) -> tuple[list[str], bool]:
    """Masked sentences and lines in order without their closing marks, and whether the last one is terminated."""
    plain = (masked(text) if plain is None else plain).strip()
    parts = [p.strip() for p in SPLIT.split(plain)]
    parts = [p for p in parts if p]
    done = not parts or bool(TERMINATED.search(parts[-1])) or parts[-1] == MASK + MASK
    return [CLOSING.sub("", p) for p in parts], done


def prose_size(unit: str) -> int:
    return len(HAN.findall(unit)) + 2 * len([w for w in WORD.findall(unit) if not HAN.search(w)])


def hangs(text: str) -> bool:
    """Breaks off visibly: an open code block, bracket or back quote, a comma, colon or connective at the end."""
    if text.count("```") % 2:
        return True
    tail = text.rstrip()
    if tail.endswith("```") or TERMINATED.search(tail):
        return False
    if re.search(r"[,，、:：;；(（]$", tail) or TAILS.search(tail) or HANGING_HAN.search(tail):
        return True
    if FENCE.sub("", tail).count("`") % 2:
        return True
    words = re.findall(r"\S+", tail)
    last = words[-1].lower() if words else ""
    return len(words) > 2 and last in HANGING and last not in WEAK


def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per pair: the defect seen in the pair alone, its sentences, and what is needed to tell whether the last is cut off."""
    for batch in batches:
        rows = []
        for answer_id, question, answer in zip(batch["response_id"], batch["question"], batch["answer"]):
            question, defect, parts, done, hanging = question or "", None, [], True, False
            if is_empty(answer):
                defect = "empty"
            elif is_copy(question, answer):
                defect = "copy"
            elif is_refusal(answer):
                defect = "refusal"
            elif is_foreign(question, answer, plain := masked(answer)):
                defect = "language"
            else:
                parts, done = units(answer, plain)
                hanging = hangs(answer)
            last = parts[-1] if parts and not done else None
            bare = bool(parts) and not any(prose_size(p.replace(MASK, " ").replace("#", " ")) for p in parts)
            rows.append((answer_id, defect, parts, last, done, hanging, bare, len(answer or "")))
        yield pd.DataFrame(rows, columns=["response_id", "defect", "parts", "last", "done", "hanging", "bare", "size"])


JUDGED = "response_id long, defect string, parts array<string>, last string, done boolean, hanging boolean, bare boolean, size int"


def extension_counts(texts: DataFrame) -> DataFrame:
    """(text, ends, inner, longer): ``longer`` sums the occurrences of all proper extensions of a text. Input: distinct texts.

    One sorted pass: extensions directly follow their text in sorted order, so a stack of the texts that are prefixes of
    the current one suffices. What is still open at the end of a range partition is compared with the later partitions.
    """
    ranged = cut(texts.repartitionByRange("text").sortWithinPartitions("text").withColumn("part", F.spark_partition_id()))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []

        def closed(until: str | None) -> list[tuple]:
            out = []
            while stack and (until is None or not until.startswith(stack[-1][0])):
                text, ends, inner, longer, part = stack.pop()
                if stack:
                    stack[-1][3] += ends + inner + longer
                out.append((text, ends, inner, longer, part, until is None))
            return out

        for batch in batches:
            out = []
            for text, ends, inner, part in zip(batch["text"], batch["ends"], batch["inner"], batch["part"]):
                out += closed(text)
                stack.append([text, int(ends), int(inner), 0, int(part)])
            yield pd.DataFrame(out, columns=["text", "ends", "inner", "longer", "part", "open"])
        yield pd.DataFrame(closed(None), columns=["text", "ends", "inner", "longer", "part", "open"])

    local = cut(ranged.select("text", "ends", "inner", "part").mapInPandas(walk, "text string, ends long, inner long, longer long, part int, open boolean"))
    bounds = cut(ranged.groupBy("part").agg(F.min("text").alias("low"), F.max("text").alias("high")))
    ahead = local.where("open").select(F.col("text").alias("prefix"), (F.col("part") + 1).alias("part"))
    met = ahead.where("false")
    while True:  # an open text goes on into the next partition if that begins with it, and beyond that if it ends with it
        on = cut(ahead.join(bounds, "part").where(F.col("low").startswith(F.col("prefix"))))
        met = met.unionByName(on.select("prefix", "part"))
        ahead = on.where(F.col("high").startswith(F.col("prefix"))).select("prefix", (F.col("part") + 1).alias("part"))
        if ahead.isEmpty():
            break
    later = (
        ranged.select("text", "ends", "inner", "part").join(met, "part").where(F.col("text").startswith(F.col("prefix")))
        .groupBy("prefix").agg(F.sum(F.col("ends") + F.col("inner")).alias("more"))
    )
    return local.join(later, F.col("text") == F.col("prefix"), "left").select("text", "ends", "inner", (F.col("longer") + F.coalesce("more", F.lit(0))).alias("longer"))


def answer_pairs(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """(response_id, question, answer): each question with the first answer before the next question, in sound order.

    Threads that are broken are left out, as are rows without created_at or with a speaker that cannot be told.
    """
    rows = chat.merged(messages)
    told = rows.where(~F.col("blank"))
    talk = F.col("speaker").isin("user", "assistant")
    facts = told.groupBy(chat.KEY).agg(
        F.max((F.col("created_at").isNull() | F.col("speaker").isNull()).cast("int")).alias("bad"),
        F.min(F.when(talk & F.col("created_at").isNotNull(), F.struct("created_at", "id", "speaker")))["speaker"].alias("opener"),
    )
    broken = facts.where("bad = 1 or opener <> 'user'").select(chat.KEY)
    usable = rows.where(talk & F.col("created_at").isNotNull()).join(broken, chat.KEY, "left_anti").drop("blank")
    seen = chat.with_last(chat.in_order(usable), {"before": F.struct("speaker", "content")})
    return seen.where((F.col("speaker") == "assistant") & (F.col("before")["speaker"] == "user")).select(
        F.col("id").alias("response_id"), F.col("before")["content"].alias("question"), F.col("content").alias("answer")
    )


def defects(pairs: DataFrame) -> DataFrame:
    """(response_id, defect) of the defective pairs: empty, copy, refusal, language or truncated; input (response_id, question, answer).

    A null answer is empty, a null question is taken for an empty one, which nothing copies or differs from in language.
    A last sentence is cut off if it hangs visibly, or if it is unterminated and its share of occurrences at the end of an
    answer, among these, those followed by more text and those of its extensions, is below ``END_SHARE``; also if it is
    unterminated and its answer has a length at which unfinished answers pile up. A bare value or identifier is sound.
    """
    spark = pairs.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)  # fixed, since AQE would join partitions that are small but slow
    seen = cut(pairs.repartition(wide, "response_id").mapInPandas(judged, JUDGED))
    fine = seen.where("defect is null and size(parts) > 0")
    open_ = fine.where("last is not null and last <> '' and not hanging and not bare").withColumn("stem", F.regexp_extract("last", r"^(.*[^A-Za-z0-9_])[A-Za-z]\w*$", 1))
    placed = fine.select(F.posexplode("parts").alias("at", "text"), F.size("parts").alias("n")).where("text <> ''")
    ending = F.col("at") == F.col("n") - 1
    stems = open_.where("stem <> ''").select(F.col("stem").alias("text"), F.lit(0).cast("long").alias("ends"), F.lit(0).cast("long").alias("inner"))
    texts = placed.select("text", ending.cast("long").alias("ends"), (~ending).cast("long").alias("inner")).unionByName(stems).groupBy("text").agg(F.sum("ends").alias("ends"), F.sum("inner").alias("inner"))
    counts = extension_counts(texts)
    stumps = open_.where("stem <> ''").groupBy("stem").agg(F.count("*").alias("stumps"))
    of_stem = counts.join(stumps, counts["text"] == stumps["stem"]).select("stem", (F.col("stumps") / F.expr("ends + inner + longer")).alias("stump_share"))
    unfinished = fine.where("not bare and (hanging or (last is not null and last <> ''))")
    lengths = unfinished.groupBy("size").agg(F.count("*").alias("n"))
    near = lengths.select(F.explode(F.expr("transform(array(-3,-2,-1,1,2,3), d -> size + d)")).alias("size"), F.col("n").alias("m"))
    spikes = lengths.withColumn("least", F.sum("n").over(Window.partitionBy()) * SPIKE_SHARE).join(near.groupBy("size").agg((F.sum("m") / 6).alias("mean")), "size", "left").where(
        (F.col("n") >= F.greatest("least", F.lit(2))) & (F.col("n") >= SPIKE_TIMES * F.coalesce("mean", F.lit(0.0))) & (F.col("size") >= SPIKE_SIZE)
    )
    cut_off = (
        open_.join(counts, open_["last"] == counts["text"])
        .join(spikes.select("size", F.lit(True).alias("limit")), "size", "left")
        .join(of_stem, "stem", "left")
        .where(
            (F.col("ends") < END_SHARE * (F.col("ends") + F.col("inner") + F.col("longer")))
            | F.coalesce(F.col("stump_share") < STUMP_SHARE, F.lit(False))
            | F.coalesce("limit", F.lit(False))
        )
        .select("response_id")
    )
    hanging = fine.where("hanging and not (bare and done)").select("response_id")
    return seen.where("defect is not null").select("response_id", "defect").unionByName(
        cut_off.unionByName(hanging).distinct().withColumn("defect", F.lit("truncated"))
    )
