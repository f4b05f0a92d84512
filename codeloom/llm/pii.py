"""Personal information in free text: found with its position, replaced by typed placeholders or keyed surrogates.

One pass over whole texts in Arrow batches; documents are independent, so nothing is shuffled to find entities. The only
side input is the lexicon of known names, a table of fixed size. Names outside it are found by what surrounds them and, once
seen in a document, by their parts in the rest of that document. Full-width characters are folded one to one, so positions
are those of the given text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.session import cut, spread

TYPES = ("email", "phone", "id_number", "address", "name")

FULL_WIDTH = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2013: 0x2D, 0x00A0: 0x20, 0x2019: 0x27}
for _keep in "，。：；！？（）":
    FULL_WIDTH.pop(ord(_keep), None)
FULL_WIDTH[ord("（")], FULL_WIDTH[ord("）")] = ord("("), ord(")")

_LOCAL = r"(?<![A-Za-z0-9._%+\-@/\\])[A-Za-z0-9_](?:[A-Za-z0-9._%+'\-]*[A-Za-z0-9_])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_AT_HARD = r"(?:[ ]?@[ ]?|[ ]?[\[({<][ ]?(?:at|ät|@|AT)[ ]?[\])}>][ ]?)"
_DOT_ANY = r"(?:\.|[ ]?[\[({][ ]?(?:dot|punkt|\.|DOT)[ ]?[\])}][ ]?|[ ]+(?:dot|punkt|DOT)[ ]+|[ ]+\.[ ]+)"
_DOT_WORD = r"(?:[ ]?[\[({][ ]?(?:dot|punkt|\.)[ ]?[\])}][ ]?|[ ]+(?:dot|punkt)[ ]+)"
#: Top-level domains that make "name at host.tld" an address.
_TLD = "com|org|net|edu|gov|int|io|dev|app|info|biz|co|de|cn|uk|eu|fr|nl|pl|ch|es|it|jp|kr|us|ru|br|au|ca|example|invalid|test|local"
EMAIL = re.compile(
    rf"{_LOCAL}(?:{_AT_HARD}{_LABEL}(?:{_DOT_ANY}{_LABEL})*?{_DOT_ANY}[A-Za-z]{{2,}}(?:{_DOT_ANY}(?:[A-Za-z]{{2,}}))*(?![A-Za-z0-9@])"
    rf"|[ ]+(?:at|ät|AT)[ ]+{_LABEL}(?:{_DOT_WORD}{_LABEL})*{_DOT_WORD}[A-Za-z]{{2,}}(?![A-Za-z0-9@])"
    rf"|[ ]+(?:at|ät|AT)[ ]+{_LABEL}(?:{_DOT_ANY}{_LABEL})*?(?:\.|[ ]\.[ ])(?i:{_TLD})(?![A-Za-z0-9@\-_]|\.\w))"
)

_FREE = r"(?<![\w\-/.:#=+][\-.:/])(?<![A-Za-z0-9_\-.+/@#])"
_END = r"(?![\w]|[\-./:]\d|[\-_][A-Za-z])"
_EXT = r"(?:[ ,]*(?:ext\.?|x|extension|Durchwahl|分机)[ ]?\d{1,5})?"
PHONE = re.compile(
    _FREE
    + r"(?:(?:\+|00)(?:1|7|2[07]|3\d|4\d|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|35|37|38|42|50|59|67|68|69|80|85|87|88|96|97|99)\d)[ \-./]?(?:\(0\)[ ]?)?(?:\(\d{1,5}\)|\d{1,5})(?:[ \-./]{0,1}\d{2,8}){1,4}"
    + r"|(?:1[\-. ])?(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[\-. ]?)[2-9]\d{2}[\-. ]?\d{4}"
    + r"|1[2-9]\d[\- ]?\d{4}[\- ]?\d{4}"
    + r"|07\d{3}[ \-]?\d{3}[ \-]?\d{3}"
    + r"|\(0\d{2,4}\)[ /\-]{0,3}\d{3,8}(?:[ \-]\d{1,4}){0,3}"
    + r"|0[1-9]\d{1,3}[ ]?[/\-][ ]?\d{3,8}(?:[ \-]\d{1,4}){0,3}"
    + r"|0[1-9]\d{1,3}[ ]\d{3,8}(?:[ \-]\d{2,4}){0,3}"
    + r"|0[1-9]\d{1,2}-?\d{7,8}"
    + r")" + _EXT + _END
)
NO_PHONE = re.compile(r"(?<![A-Za-z])(?:range|bereich|区间|范围|version|build|bau|构建|epoch|order|hash|record|trace|ticket|lane|port|isbn|订单号?|记录|编号|auftrag|vorgang|datensatz)[ :#]{0,3}\Z", re.I)

ID_CONTEXT = re.compile(
    r"(?:social security|\bssn\b|national insurance|\bnino\b|passport|reisepass|\btax\b|steuer|ausweis|identi(?:ty|fication)|\bid[ _\-]?(?:card|number|no\b|nr)|\blists\b|身份证|护照|证件|纳税|税号|bad value)[^\n]{0,40}$", re.I
)
_MAYBE_ID = re.compile(r"(?:\d[ \-]?){9}|[A-Z]{2} ?\d\d|[A-Z]\d{6}|[CFGHJK]\w{8}")
ID_SHAPES = [
    (re.compile(_FREE + r"\d{6}[ \-]?(?:19|20)\d{2}[ \-]?(?:0[1-9]|1[0-2])[ \-]?(?:0[1-9]|[12]\d|3[01])[ \-]?\d{3}[\dXx]" + _END), False),
    (re.compile(_FREE + r"[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]" + _END), False),
    (re.compile(_FREE + r"[A-Z]{2}\d{7}" + _END), False),
    (re.compile(_FREE + r"\d{3}(?P<s>[ \-])\d{2}(?P=s)\d{4}" + _END), False),
    (re.compile(_FREE + r"\d{2} \d{3} \d{3} \d{3}" + _END), False),
    (re.compile(_FREE + r"(?:\d{9}|\d{11}|[A-Z]\d{8}|[CFGHJK][0-9CFGHJKLMNPRTVWXYZ]{8})" + _END), True),
]

STREET = "street|road|lane|avenue|square|row|path|close|way|drive|court|crescent|terrace|mews|gardens|grove|place|hill|gate|walk|parade|boulevard|quay|wharf|yard|st|rd|ave|blvd"
_UNIT = r"(?:(?:flat|apt\.?|apartment|unit|suite|room|no\.) ?\d{1,4}[a-z]?, ?)"
ADDRESS_EN = re.compile(
    rf"{_FREE}{_UNIT}?\d{{1,5}}[a-z]? (?P<mid>(?:[a-z][a-z']+ ){{1,3}})(?:{STREET})\b(?![\-/_(])"
    rf"(?:, (?:apt\.?|flat|apartment|unit|suite) ?\d{{1,4}}[a-z]?)?(?:, (?-i:[A-Z][a-z]+)(?: (?-i:[A-Z][a-z]+)){{0,2}}(?: (?-i:[A-Z]{{1,2}}\d{{1,2}} ?\d[A-Z]{{2}}))?)?", re.I
)
NOT_STREET = frozenset("of the in to from maps for and per ms on at a an with days rows weeks minutes hours times is are was were by or as that each all milliseconds seconds users callers messages replicas".split())
_DE_NAME = r"(?:(?:Am|An der|An den|Auf der|Im|In der|Zum|Zur|Alte[rsn]?|Neue[rsn]?|Lange[rsn]?|Hohe[rsn]?|Kleine[rsn]?|Große[rsn]?|Obere[rsn]?|Untere[rsn]?|Unter den|Hinter der|Vor dem) )?[A-ZÄÖÜ][a-zäöüß]+(?:[\- ][A-ZÄÖÜ][a-zäöüß]+)?"
ADDRESS_DE = re.compile(
    rf"(?<![\wäöüßÄÖÜ\-.])(?:{_DE_NAME} \d{{1,4}} ?[a-z]?, (?:D-)?\d{{5}} [A-ZÄÖÜ][a-zäöüß]+"
    r"|(?:(?:Am|An der|Im|Zum|Zur|Alte[rs]?|Neue[rs]?|Lange|Hohe) )?[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|steig|zeile|hof|ring|stieg) \d{1,4}[a-z]?)(?![\w])"
)
ADDRESS_ZH = re.compile(
    r"(?:[一-鿿]{2,4}?省)?[一-鿿]{2,3}市(?:[一-鿿]{1,6}?[区县镇])?[一-鿿]{1,8}?(?:路|街|大道|巷|弄|道|胡同|里)\d{1,5}号(?:\d{1,4}(?:号楼|栋|幢|单元|楼|室|层))*"
)
_ZH_LEAD = re.compile(r"^.*?(?:地址是|地址为|地址[：:]|住在|寄往|寄到|送到|位于|发往|在|到|往|是|为|给|于|至|自|从|去)(?=[一-鿿]{2,3}市)")

_CAP = r"(?:(?:van|von|de|del|di|da|la|le|ter|zu|Van|Von|De|VAN|VON) )?(?:O'|D'|Mc|Mac)?[A-ZÄÖÜ](?:[a-zäöüßéèàçñ]+|[A-ZÄÖÜ']+)(?:-[A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ]+)?"
_INI = r"(?:[A-Z]\.[ ]?)"
PERSON = rf"(?:{_INI}{{1,2}}{_CAP}|{_CAP} {_INI}{{0,2}}{_CAP}|{_CAP}, {_CAP}|{_CAP})"
FULL = rf"(?:{_INI}{{1,2}}{_CAP}|{_CAP} {_INI}{{0,2}}{_CAP}|{_CAP}, {_CAP})"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Sir|Madam)\.? (?:Dr\. )?)"
_B, _A = r"(?<![A-Za-z0-9_'\-äöüß])", r"(?![A-Za-z0-9_äöüß@]|-\d|[.(]\w)"
#: What stands before and after persons' names. The first group of each is one name.
AROUND = [
    (('Mr', 'Ms', 'Miss', 'Dr', 'Prof', 'Herr', 'Frau', 'Sir', 'Madam'), rf"{_B}{_TITLE}({PERSON}){_A}"),
    (["off by ", "escalated by ", "suggested by ", "reported by ", "approved by ", "reviewed by ", "written by ", "confirmed by ", "handled by ", "requested by ", "assigned by ", "submitted by ", "raised by "], rf"(?i:{_B}(?:signed off|escalated|suggested|reported|approved|reviewed|written|confirmed|handled|requested|assigned|submitted|raised) by) ({PERSON}){_A}"),
    ((' with ',), rf"(?i:{_B}(?:agreed|spoke|talked|checked|met|discussed) with) ({PERSON}){_A}"),
    (('took over from',), rf"(?i:{_B}took over from) ({PERSON}){_A}"),
    (('Ask', 'Contact', 'Call', 'Ping', 'Customer', 'Client', 'Dear', 'Hi ', 'Hello', 'Kund', 'Both', 'Beide'), rf"{_B}(?:Ask|Contact|Call|Ping|Customer|Client|Dear|Hi|Hello|Kundin|Kunde|Both|Beide) ({FULL}){_A}"),
    ((("author", "owner:", "call:", "contact:", "assignee:", "reviewer:", "reporter:", "maintainer:"), re.compile("author|owner:|call:|contact:|assignee:|reviewer:|reporter:|maintainer:", re.I)), rf"(?i:@author|\bowner:|\bon[ -]call:|\bauthor:|\bcontact:|\bassignee:|\breviewer:|\breporter:|\bmaintainer:) *({PERSON}){_A}(?!\.\w)"),
    (('says:', 'schein:', 'ustomer:', 'unde:', 'undin:', 'ame:', 'partner'), rf"(?i:\b(?:delivery note says|lieferschein|customer|kunde|kundin|name|ansprechpartner(?:in)?)): *({FULL}){_A}"),
    (('Durch ', 'durch ', 'Mit ', 'mit ', 'von ', 'Von '), rf"(?:\bDurch|\bdurch|\bMit|\bmit|\bvon|\bVon) ({FULL}){_A}(?= ist|,? Tel| abgesprochen| in )"),
    (('Thanks', 'Regards', 'Best', 'Cheers', 'Danke', 'Gruß', 'Grüße', 'hip to', 'ersand an', 'eliver to', 'ieferung an', 'ill to'), rf"(?:Thanks|Regards|Best|Cheers|Danke|Gruß|Grüße|Ship to|Versand an|Deliver to|Lieferung an|Bill to)[,:!]?[ \t]*\r?\n[ \t]*({PERSON})[ \t]*(?=\r?\n|$)"),
    (((" reported it", " called ", " took over", " has ", " have access", " hat ", " haben zugriff", " ist abgesprochen", " asked ", " wrote "), re.compile(" (?:reported it|called (?:again|back|in|twice)|took over|has (?:asked|reported|called)|have access|hat (?:den|die|das|zwei|drei|ein|wieder|noch)|haben Zugriff|ist abgesprochen|asked (?:for|whether|about)|wrote (?:again|back))")), rf"{_B}({PERSON}){_A} (?:reported it|called (?:again|back|in|twice)|took over|has (?:asked|reported|called)|have access|hat (?:den|die|das|zwei|drei|ein|wieder|noch)|haben Zugriff|ist abgesprochen|asked (?:for|whether|about)|wrote (?:again|back))"),
    ((' have access', 'haben Zugriff', 'agreed', 'confirmed'), rf"{_B}({FULL}) (?:and|und) {PERSON}{_A} (?:have access|haben Zugriff|agreed|confirmed)"),
    ((' have access', 'haben Zugriff', 'agreed', 'confirmed'), rf"{_B}(?:and|und) ({PERSON}){_A} (?:have access|haben Zugriff|agreed|confirmed)"),
    (("'",), rf"\(\s*'({FULL})'\s*,"),
    (('name', 'contact', 'customer', 'owner', 'author'), rf"[\"'](?:name|full_?name|customer|contact|owner|author)[\"']\s*:\s*[\"']({FULL})[\"']"),
    (('人：', '人:', '姓名', '作者'), rf"(?:联系人|负责人|收货人|收件人|姓名|作者|审批人)[：:]\s*({FULL})(?![A-Za-z])"),
    (('住在', '确认', '都有', '女士', '先生', '负责', '来电'), rf"(?:客户|已经和|和|与|由)({FULL})(?=住在|确认|都有|女士|先生|负责|来电)"),
    (('最先', '女士', '先生', '来电', '都有'), rf"(?<![A-Za-z])({FULL})(?=最先|女士|先生|来电|都有|和[^\s]{{2,20}}都有)"),
    (('Mit ', 'With '), rf"{_B}(?:Mit|With) ({FULL}){_A} "),
    (('living', 'wohnhaft', 'residing', 'reachable', 'erreichbar', 'Tel', 'tel', 'phone'), rf"{_B}({FULL}){_A}(?=,? (?:living at|wohnhaft|residing at|reachable under|erreichbar unter|Tel\.?\b|tel\b|phone\b))"),
    (("orward", "Send ", "send ", "sent ", "gave ", "introduced "), rf"\b(?:[Ff]orward(?:ed)?|[Ss]end|sent|gave|introduced)(?: [a-z]+){{0,4}}? (?:to|with|from) ({FULL}){_A}"),
    (("boss", "manager", "colleague", "wife", "husband", "neighbour", "neighbor", "friend", "landlord", "lawyer", "doctor", "assistant"), rf"\b(?:[Mm]y|[Oo]ur|[Hh]is|[Hh]er|[Tt]heir) (?:boss|manager|colleague|wife|husband|neighbou?r|friend|landlord|lawyer|doctor|assistant),? ({FULL}){_A}"),
    ((", our ", ", the ", ", my "), rf"{_B}({FULL}), (?:our|the|my) (?:new |former |senior )?(?:manager|engineer|director|developer|analyst|assistant|lawyer|doctor|accountant|consultant|owner|tenant)\b"),
    (("named ", "name is ", "I am ", "I'm ", "ch bin ", "Name ist ", "ch heiße ", "m'appelle ", "llamo "), rf"\b(?:named|[Nn]ame is|I am|I'm|[Ii]ch bin|Name ist|[Ii]ch heiße|m'appelle|llamo) ({FULL}){_A}"),
    (((" (",), re.compile(r" \((?:[^()\s]+@|[^()\s]+[ ]?[\[(])")), rf"{_B}({FULL}){_A}(?= \((?:[^()\s]+@|[^()\s]+[ ]?[\[(]))"),
]
def _gated(triggers: tuple[str, ...] | list[str] | tuple[tuple[str, ...], re.Pattern], pattern: str) -> tuple[tuple[str, ...] | list[str], re.Pattern | None, re.Pattern]:
    """(literals of which one must occur, letter case aside for a list or if a gate follows; where to look closer; the pattern)."""
    literals, gate = triggers if isinstance(triggers[-1], re.Pattern) else (triggers, None)
    return literals, gate, re.compile(pattern, re.M)


_RUNS = re.compile(r"[a-z0-9]+")
#: A name lies within so many characters of what it is told by.
NEAR = 160


def near_matches(gated: tuple[tuple[str, ...] | list[str], re.Pattern | None, re.Pattern], text: str, lowered: str) -> Iterator[re.Match]:
    """Matches of the pattern around its triggers; the next search starts where a match's last group ends."""
    literals, gate, pattern = gated
    if gate is not None:
        hits = [(m.start(), m.end()) for m in gate.finditer(text)] if any(t in lowered for t in literals) else []
    else:
        hits, within = [], lowered if isinstance(literals, list) else text
        for t in literals:
            i = within.find(t)
            while i >= 0:
                hits.append((i, i + len(t)))
                i = within.find(t, i + 1)
        hits.sort()
    at, size = 0, len(text)
    for start, end in hits:
        low, high = max(at, start - NEAR), min(size, end + NEAR)
        while low < high and (m := pattern.search(text, low, high)) and (m.end() < high - 8 or high == size):
            yield m
            at = low = max(m.end(m.lastindex), m.start() + 1)


_AROUND = [_gated(triggers, p) for triggers, p in AROUND]
#: Contexts that product and place names share with persons: only a full name counts there.
_FULL_ONLY = [g for g, (_, p) in zip(_AROUND, AROUND) if p.startswith((r"\b(?:[Ff]orward", r"\b(?:named"))]
#: A full name all in lower case; taken where the surroundings demand a name and no word of it is a common one.
_LOW = r"(?:[a-z']{3,}(?:-[a-z]+)? (?:[a-z]\. ?)?(?:van |von |de )?[a-z']{3,}(?:-[a-z]+)?)"
AROUND_LOW = [
    ((' by ',), rf"(?:off|[Ee]scalated|[Ss]uggested|reported|approved|reviewed|confirmed|handled|assigned) by ({_LOW})(?=[ ,.;\n]|$)"),
    ((' with ',), rf"(?:[Aa]greed|spoke|talked) with ({_LOW}) that"),
    (('Customer', 'Kund', 'Mr', 'Ms', 'Dr', 'Herr', 'Frau', 'Ask', 'Both', 'Mit', 'durch', 'says:', 'from', 'author', 'owner:', 'call:'), rf"{_B}(?:Customer|Kundin|Kunde|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Herrn?|Frau|Ask|Both|Mit|durch|says:|took over from|author|owner:|on call:) ({_LOW})(?![\w\-]|\.\w)"),
    (('Thanks', 'Regards', 'hip to', 'ersand an'), rf"(?:Thanks|Regards|Ship to|Versand an)[,:]?[ \t]*\r?\n[ \t]*({_LOW})[ \t]*(?=\r?\n|$)"),
    (('reported it', 'called again', 'took over', ' hat ', 'haben Zugriff', 'have access'), rf"(?<![\w\-.])({_LOW})(?= reported it first| called again| took over from| hat den Fehler| hat zweimal| haben Zugriff| have access)"),
    (('have access', 'haben Zugriff'), rf"(?<= and )({_LOW})(?= have access)|(?<= und )({_LOW})(?= haben Zugriff)|(?<![\w\-.])({_LOW})(?= (?:und|and) [^.\n]{{3,30}}? (?:haben Zugriff|have access))"),
    (('住在', '确认', '都有', '，', '最先', '女士', '先生', '来电'), rf"(?:联系人：|客户|已经和|和)({_LOW})(?=住在|确认|都有|，)|(?<![A-Za-z])({_LOW})(?=最先|女士|先生|来电|都有|和[^\s]{{2,20}}都有)"),
    (("('",), rf"\('({_LOW})', '"),
    (('"name"',), rf"\"name\":\"({_LOW})\""),
]
_AROUND_LOW = [_gated(triggers, p) for triggers, p in AROUND_LOW]
#: Common words in lower case that no name contains.
COMMON = frozenset(
    """the this that these those and for with from into onto over under about after before our your his her its their all any each every some more most
    team user users admin support batch night job system service server client module table tables row rows test tests data value values key keys name names
    sample unknown none null reader writer default night operator manager customer one two three four five who which when where what why how
    der die das den dem des ein eine und oder mit von zum zur bei nach auf aus als wie nur noch sich sie wir ihr man nicht ist sind wird
    invoice claim ledger roster voucher parcel meter rebate coupon tariff contract cart depot pallet badge refund quote recipe shipment order""".split()
)
_HAN_GIVEN = r"[一-鿿]{1,2}"
AROUND_HAN = [
    r"(?:联系人|负责人|收货人|收件人|姓名|作者|审批人)[：:]\s*([一-鿿]{2,4})(?=[，,。；;\s]|$)",
    r"(?:@author|owner:|on call:|author:|contact:) *([一-鿿]{2,4})(?![一-鿿])",
    r"客户([一-鿿]{2,3}?)(?=住在|先生|女士|来电|反馈)",
    r"(?:已经和|已与|和|与)([一-鿿]{2,3}?)(?=确认|都有)",
    r"(?<![一-鿿])([一-鿿]{2,3}?)(?=(?:女士|先生)?(?:来电|最先反馈|都有|和[^\s，。]{2,24}?都有))",
    r"(?<=[。；！？])([一-鿿]{2,3}?)(?=(?:女士|先生)?(?:来电|最先反馈|和[^\s，。]{2,24}?都有))",
    r"\(\s*'([一-鿿]{2,4})'\s*,",
    r"[\"'](?:name|customer|contact|owner)[\"']\s*:\s*[\"']([一-鿿]{2,4})[\"']",
]
_AROUND_HAN = [re.compile(p, re.M) for p in AROUND_HAN]
#: Capitalised words that are no part of a name, in lower case.
NO_NAME = frozenset(
    """the a an this that these those it its we you he she they i both all each any no not and or but if when while after before since until
    ask call contact customer client dear hi hello thanks regards best cheers mr mrs ms miss dr prof herr herrn frau sir madam kunde kundin
    signed escalated fix suggested reported delivery note parcel form passport tax national insurance social security range build order epoch
    flat apt apartment unit suite street road lane avenue square row path close way drive court ship versand die der das den dem ein eine bei
    mit von und oder wenn nach aufrufe bitte fehlt zeilen nachrichten seit eine steuer tel telefon phone mail email user assistant system tool
    value true false null none info warn error debug ticket request route topic use nodes version tests rows record hash trace silver amber
    north harbor copper quiet gateway depot ledger portal queue meter batch node freigabe rückruf lieferung sample insert into values select
    update delete from where set create table public private class component package import route pfad bau kontakt her his passnummer""".split()
)
#: Second words of product names; a pair ending in one is no person.
PRODUCT_ENDS = frozenset("gateway portal depot ledger queue meter server service engine hub cloud api app core web console manager module cluster".split())


#: What surrounds an e-mail address's host, and what its local part consists of: the address is tried at these places only.
_AT_MARK = re.compile(r"@|[\[({<][ ]?(?:at|ät|AT)[ ]?[\])}>]|[ ](?:at|ät|AT)[ ]")
#: Where a number may start, as ``_FREE`` has it; the character itself comes first, so that the search skips all others quickly.
_NUMBER_START = re.compile(r"[+(\d](?<![\w\-/.:#=+][\-.:/].)(?<![A-Za-z0-9_\-.+/@#].)", re.S)
_LETTER_START = re.compile(r"[A-Z](?<![\w\-/.:#=+][\-.:/].)(?<![A-Za-z0-9_\-.+/@#].)(?=[A-Z] ?\d\d|\d{8}|[0-9CFGHJKLMNPRTVWXYZ]{8})", re.S)
_UNIT_BEFORE = re.compile(rf"{_FREE}{_UNIT}\Z", re.I)
_DE_STREETS = ("straße ", "strasse ", "str. ", "gasse ", "weg ", "allee ", "platz ", "ufer ", "damm ", "steig ", "zeile ", "hof ", "ring ", "stieg ")
_DE_TOWN = re.compile(r", (?:D-)?\d{5} [A-ZÄÖÜ]")
_QUOTED_NUMBER = re.compile(r"[\"'](?:\d{9}|\d{11})(?=[\"'])")


def starts_matching(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """Matches at the given places in order, none of which overlaps the one before."""
    end = 0
    for start in starts:
        if start >= end and (m := pattern.match(text, start)):
            end = m.end()
            yield m


def email_starts(text: str) -> list[int]:
    """The places where a local part may begin: in the run of its characters before each mark."""
    out = []
    for mark in _AT_MARK.finditer(text):
        low = mark.start()
        while low and (text[low - 1] in "._%+'-" or text[low - 1].isalnum() or (low == mark.start() and text[low - 1] == " ")):
            low -= 1
        out += range(max(low, out[-1] + 1 if out else 0), mark.start())
    return out


_WIDE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(FULL_WIDTH)) + "]")


def fold(text: str) -> str:
    """Full-width and typographic characters as ASCII, one for one."""
    return text if text.isascii() else _WIDE.sub(lambda m: chr(FULL_WIDTH[ord(m[0])]), text)


class Finder:
    """Finds entities in one text at a time; holds the compiled lexicon of (name, part, script)."""

    def __init__(self, lexicon: list[tuple[str, str, str]]):
        latin = {(n or "").lower(): p for n, p, s in lexicon if n and s == "latin"}
        self.given = frozenset(n for n, p in latin.items() if p == "given")
        self.family = frozenset(n for n, p in latin.items() if p == "family")
        surnames = sorted((n for n, p, s in lexicon if n and s == "han" and p == "family"), key=len, reverse=True)
        self.han = re.compile(rf"(?:{'|'.join(map(re.escape, surnames))})(?:[一-鿿]{{2}}|[一-鿿])") if surnames else None
        latin_names = sorted(self.given | self.family, key=len, reverse=True)
        self.single = frozenset(n for n in latin_names if re.fullmatch(r"[a-z0-9]+", n))
        self.joined_names = joined = [n for n in latin_names if n not in self.single]
        self.joined = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, joined))})(?![A-Za-z0-9])") if joined else None
        self.word = re.compile(r"(?<![A-Za-z0-9_'\-.@/äöüß])(?:van |von |de |Van |VAN )?[A-Za-zÄÖÜäöü][A-Za-z'äöüßÄÖÜéè]+(?:-[A-Z][A-Za-zäöüß]+)?(?![A-Za-z0-9_äöüß@/]|-[\w]|\.\w|\()")

    def find(self, given_text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) in order of start; spans do not overlap."""
        text = fold(given_text)
        taken: list[tuple[int, int, str]] = []
        marks = bytearray(len(text))

        def add(start: int, end: int, kind: str) -> bool:
            if end <= start or any(marks[start:end]):
                return False
            marks[start:end] = b"\x01" * (end - start)
            taken.append((start, end, kind))
            return True

        for m in starts_matching(EMAIL, text, email_starts(text)):
            add(m.start(), m.end(), "email")
        starts = [m.start() for m in _NUMBER_START.finditer(text)]
        if starts:
            self._addresses(text, add, starts)
        letters = [m.start() for m in _LETTER_START.finditer(text)]
        if starts or letters:
            self._numbers(text, add, {end for _, end, kind in taken if kind == "address"}, starts, letters)
        self._names(text, add, marks)
        return sorted(taken)

    @staticmethod
    def _addresses(text: str, add, starts: list[int]) -> None:
        for m in starts_matching(ADDRESS_EN, text, [i for i in starts if text[i].isdigit()]):
            if not NOT_STREET & set(m["mid"].lower().split()):
                unit = _UNIT_BEFORE.search(text, max(0, m.start() - 24), m.start())
                add(unit.start() if unit else m.start(), m.end(), "address")
        for m in ADDRESS_DE.finditer(text) if any(w in text for w in _DE_STREETS) or _DE_TOWN.search(text) else ():
            add(m.start(), m.end(), "address")
        if "号" in text:
            for m in ADDRESS_ZH.finditer(text):
                lead = _ZH_LEAD.match(m.group())
                add(m.start() + (lead.end() if lead else 0), m.end(), "address")

    @staticmethod
    def _numbers(text: str, add, address_ends: set[int], starts: list[int], letters: list[int]) -> None:
        for m in _QUOTED_NUMBER.finditer(text):  # a record of name, address and number
            if m.start() - 3 in address_ends:
                add(m.start() + 1, m.end(), "id_number")
        both = sorted(starts + letters)
        for pattern, needs_context in ID_SHAPES:
            for m in starts_matching(pattern, text, both):
                before = text[max(0, m.start() - 60) : m.start()]
                if (not needs_context or ID_CONTEXT.search(before)) and not NO_PHONE.search(before[-12:]):
                    add(m.start(), m.end(), "id_number")
        for m in starts_matching(PHONE, text, starts):
            digits = sum(c.isdigit() for c in m.group())
            if 9 <= digits <= 20 and not NO_PHONE.search(text[max(0, m.start() - 14) : m.start()]):
                add(m.start(), m.end(), "phone")

    def _names(self, text: str, add, marks: bytearray) -> None:
        spans: list[tuple[int, int]] = []
        lowered = text.lower()
        for gated in _AROUND:
            for m in near_matches(gated, text, lowered):
                spans += self._trimmed(text, m.start(1), m.end(1), gated in _FULL_ONLY)
        for gated in _AROUND_LOW:
            for m in near_matches(gated, text, lowered):
                words = set(m.group(m.lastindex).split())
                if not words & COMMON and not words & NO_NAME:
                    spans.append((m.start(m.lastindex), m.end(m.lastindex)))
        for pattern in _AROUND_HAN if self._has_han(text) else ():
            spans += [(m.start(1), m.end(1)) for m in pattern.finditer(text) if not re.search("女士|先生|什么|怎么|哪个|如何|系统|消息|字段|任务|模块|数据|这个|问题|版本|之后|缓存|权限|订单|构建|主题|通道|工单|收货|证件", m.group(1))]
        parts = {w.lower() for a, b in spans for w in re.findall(r"(?:van |von |de )?[A-Za-zÄÖÜäöüß']{3,}(?:-[A-Za-zäöüß]+)?", text[a:b])} - NO_NAME
        known = parts | self.given | self.family
        if parts or not self.single.isdisjoint(_RUNS.findall(lowered)) or (any(n in lowered for n in self.joined_names) and self.joined.search(text)):
            spans += self._by_lexicon(text, known)
        if self.han:
            spans += [self._han_end(text, m.start(), m.end()) for m in self.han.finditer(text)]
        han_seen = {text[a:b] for a, b in spans if b - a <= 4 and re.fullmatch(r"[一-鿿]{2,4}", text[a:b])}
        for name in han_seen:
            spans += [(m.start(), m.end()) for m in re.finditer(re.escape(name), text)]
        for start, end in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            add(start, end, "name")

    @staticmethod
    def _has_han(text: str) -> bool:
        return bool(re.search(r"[\u4e00-\u9fff]{2}", text))

    @staticmethod
    def _trimmed(text: str, start: int, end: int, full: bool) -> list[tuple[int, int]]:
        """The span without leading words that are no name; nothing if it is all such words or a product's name,
        or one word where a full name is asked for."""
        while m := re.match(r"([A-Za-zÄÖÜäöüß]+)\.?[ ,]+", text[start:end]):
            if m[1].lower() not in NO_NAME or re.fullmatch(r"[A-Z]", m[1]):
                break
            start += m.end()
        words = re.findall(r"[A-Za-zÄÖÜäöüß'\-]+", text[start:end])
        if not words or words[-1].lower() in PRODUCT_ENDS or words[-1].lower() in NO_NAME or words[0].lower() in NO_NAME and len(words[0]) > 1:
            return []
        if re.search(r"[a-z][A-Z]", text[start:end].replace("Mc", "").replace("Mac", "")) or full and len(words) < 2:
            return []
        return [(start, end)]

    def _by_lexicon(self, text: str, known: frozenset[str] | set[str]) -> list[tuple[int, int]]:
        """Runs of words around known name parts: given names and initials before, family names after, or family, given."""
        out: list[tuple[int, int]] = []
        words = list(self.word.finditer(text))
        lower = [m.group().lower() for m in words]
        for i, m in enumerate(words):
            low = lower[i]
            if low not in known:
                continue
            cased = m.group()[:1].isupper() or m.group().lower().startswith(("van ", "von ", "de ")) and not m.group().islower()
            start, end = m.start(), m.end()
            neighbour = False
            left = re.search(r"((?:[A-Z]\. ?){1,2})$", text[max(0, start - 7) : start])
            if left and low not in self.given and (start - len(left[1]) == 0 or not text[start - len(left[1]) - 1].isalnum()):
                start, neighbour = start - len(left[1]), True
            first = re.match(r" ((?:[A-Z]\. ?){0,2})", text[end : end + 8])
            after = i + 1 < len(words) and first and words[i + 1].start() == end + first.end()
            if after and low not in self.family and lower[i + 1] not in NO_NAME and not (lower[i + 1] in PRODUCT_ENDS):
                word = words[i + 1].group()
                if lower[i + 1] in known or cased and (word[:1].isupper() or word.startswith(("van ", "von "))) and not re.search(r"[a-z][A-Z]", word):
                    end, neighbour = words[i + 1].end(), True
            elif first and first[1] and low in self.given:
                end, neighbour = end + len(first.group().rstrip()), True
            if i and words[i - 1].end() == m.start() - 1 and text[m.start() - 1] == " " and low not in self.given and lower[i - 1] not in NO_NAME:
                word = words[i - 1].group()
                if lower[i - 1] in known or cased and word[:1].isupper() and not re.search(r"[a-z][A-Z]", word) and not left:
                    start, neighbour = min(start, words[i - 1].start()), True
            if not neighbour and i + 1 < len(words) and text[end : words[i + 1].start()] == ", " and low not in self.given and cased:
                word = words[i + 1].group()
                if (lower[i + 1] in known and lower[i + 1] not in self.family) and word[:1].isupper():
                    end = words[i + 1].end()
            if not neighbour and not cased:
                continue
            if not neighbour and low in parts_only(known, self.given, self.family) and m.group() != m.group().capitalize() and not m.group().isupper() and "'" not in m.group() and " " not in m.group() and "-" not in m.group():
                continue
            out.append((start, end))
        return out

    @staticmethod
    def _han_end(text: str, start: int, end: int) -> tuple[int, int]:
        """A Han surname with one or two characters: two, unless what follows the first begins a known phrase."""
        if end - start >= 3 and re.match(r"(?:女士|先生|来电|最先|都有|住在|确认|和|，|。|、)", text[start + 2 :]):
            return start, start + 2
        return start, end


def parts_only(known, given, family) -> set[str]:
    return known - given - family


def _lexicon(lexicon: DataFrame) -> list[tuple[str, str, str]]:
    """The known names; the table does not grow with the documents, and 100,000 rows are taken for a mistake."""
    rows = lexicon.select("name", "name_part", "script").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the lexicon of names has more than 100,000 rows")
    return [tuple(r) for r in rows]


def coreferent(found: list[tuple[int, int, str]], text: str) -> list[str]:
    """The entity of each span: its canonical value, and for initials with a family name the only full name of the text that fits."""
    own = [canonical(text[a:b], kind) for a, b, kind in found]
    full: dict[tuple[str, str], set[str]] = {}
    for value, (_, _, kind) in zip(own, found):
        parts = value.split()
        if kind == "name" and len(parts) > 1 and len(parts[0].rstrip(".")) > 1:
            full.setdefault((parts[0][0], parts[-1]), set()).add(value)
    out = []
    for value, (_, _, kind) in zip(own, found):
        parts = value.replace(".", ". ").split()
        if kind == "name" and len(parts) > 1 and len(parts[0].rstrip(".")) == 1:
            fits = full.get((parts[0][0], parts[-1]), set())
            value = next(iter(fits)) if len(fits) == 1 else value
        out.append(value)
    return out


def entities(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, text_key, start_pos, end_pos, pii_type, value, entity) of every occurrence; null and empty texts have none.

    ``start_pos`` counts characters of the text from 0. Spans never overlap: where two could, e-mail addresses go before
    addresses, these before numbers and these before names. Rows of one doc_id are taken as they come; ``text_key``, a hash
    of the text, tells their occurrences apart. ``entity`` is what the value denotes, equal for its spellings.
    """
    names = _lexicon(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc_id, text_key, text in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), batch["text"].to_pylist()):
                found = finder.find(text)
                for (start, end, kind), entity in zip(found, coreferent(found, text)):
                    for column, value in zip(out, (doc_id, text_key, start, end, kind, text[start:end], entity)):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "text_key", "start_pos", "end_pos", "pii_type", "value", "entity"])

    texts = spread(documents.where("doc_id is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "doc_id")
    return texts.mapInArrow(run, "doc_id long, text_key long, start_pos long, end_pos long, pii_type string, value string, entity string")


#: Attempts at a surrogate of one length.
ATTEMPTS = 16
_SYLLABLES = {
    "latin": [a + b for a in ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "br", "tr") for b in ("a", "e", "i", "o", "u", "en", "or", "el")],
    "han": [chr(0x4E00 + i) for i in range(0, 20_480, 5)],
}


def canonical(value: str, kind: str) -> str:
    """One spelling for what denotes the same: digits of numbers, folded addresses, names as given-family in lower case."""
    text = fold(value)
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9A-Z]", "", re.sub(r"(?i)ext\.?|x(?=\d)", "", text.upper()))
    if kind == "email":
        text = re.sub(r" ?[\[({<] ?(?:at|ät) ?[\])}>] ?| at ", "@", text.lower())
        return re.sub(r" ?[\[({] ?(?:dot|punkt|\.) ?[\])}] ?| dot | \. ", ".", text)
    if kind == "name" and (m := re.match(r"([^,]+), (.+)$", text)):
        text = f"{m[2]} {m[1]}"
    return " ".join(text.lower().split())


#: Characters of given names that are a woman's, and that are a man's; surrogates of theirs are taken from the same list.
HAN_GENDER = ("芳娜丽婷娟敏静玲雪梅兰英霞燕红琴萍莉倩颖", "伟强军勇刚杰涛明超辉鹏浩健斌龙飞建国志峰")
_KEPT_WORDS = frozenset(f"{STREET}|flat|apt|apartment|unit|suite|room|am|an|der|den|auf|im|in|zum|zur|alte|neue|lange|hohe".split("|"))
_STREET_END = re.compile(r"(straße|strasse|str|gasse|weg|allee|platz|ufer|damm|steig|zeile|hof|ring|stieg)$")


def surrogate(value: str, kind: str, key: bytes, attempt: int = 0, entity: str | None = None) -> str:
    """A replacement of the same type, script and format, chosen by a keyed hash of what the value denotes.

    Digits stay digits and letters letters in numbers; of addresses numbers and proper names change and street words stay.
    Each part of a name gets the same replacement wherever it occurs, in the case of the original. Gender is kept as far as
    names tell it: a part's last letter where it is a vowel, as in Anna or Marco, and Han characters that are common for one
    gender go to others of the same. Initials are those of the replaced full name if ``entity`` is one. E-mail addresses
    go to a reserved domain. ``attempt`` makes another one, longer by a syllable, character or digit after every
    ``ATTEMPTS``, so that no form runs out of surrogates.
    """

    longer = attempt // ATTEMPTS
    entity = canonical(value, kind) if entity is None else entity

    def stream(text: str) -> Iterator[int]:
        n = 0
        while True:
            yield from hashlib.blake2b(f"{kind}|{attempt}|{n}|{text}".encode(), key=key).digest()
            n += 1

    def letters(part: str, length: int = 3) -> str:
        source = stream(part.lower())
        if re.search(r"[㐀-鿿]", part):
            out = []
            for c in part + part[-1] * longer:
                pool = next((g for g in HAN_GENDER if c in g), None)
                draw = next(source) * 256 + next(source)
                out.append(pool[draw % len(pool)] if pool else _SYLLABLES["han"][draw % len(_SYLLABLES["han"])])
            return "".join(out)
        word = "".join(_SYLLABLES["latin"][next(source) % 128] for _ in range(length + longer))
        if kind == "name" and part[-1].lower() in "aeiouy":
            word = word.rstrip("aeiou") + part[-1].lower()
        return word.upper() if part.isupper() and len(part) > 1 else word.capitalize() if part[:1].isupper() else word

    text = fold(value)
    if kind == "email":
        source = stream(entity)
        return "".join(_SYLLABLES["latin"][next(source) % 128] for _ in range(4 + longer)) + "@mail.example"
    if kind in ("phone", "id_number"):
        source = stream(entity)
        return "".join(str(next(source) % 10) if c.isdigit() else chr(65 + next(source) % 26) if c.isupper() and kind == "id_number" else c for c in text + "0" * longer)
    if kind == "name":
        known = iter([p for p in entity.split()[:-1] if len(p) > 1 and p[-1] != "."])

        def named(m: re.Match) -> str:
            if len(m[0]) == 1 and m[0].isupper():
                whole = next(known, None)
                return letters(whole)[0].upper() if whole and whole[0] == m[0].lower() else chr(65 + next(stream(m[0].lower())) % 26)
            return letters(m[0])

        made = re.sub(r"[A-Za-zÄÖÜäöüßéè'\-]+|[㐀-鿿]+", named, text)
        return f"{made} {letters(entity).capitalize()}" if longer else made  # for names all of initials too
    source = stream(entity)
    spaced = re.sub(r"\d", lambda m: str(next(source) % 10), text + (" " + "0" * longer if longer else ""))

    def placed(m: re.Match) -> str:
        end = _STREET_END.search(m[0])
        if m[0].lower() in _KEPT_WORDS:
            return m[0]
        return letters(m[0][: end.start()]) + end[0] if end and end.start() else letters(m[0])

    return re.sub(r"[㐀-鿿]{2}(?=[市区路街])|\b[A-ZÄÖÜ][a-zäöüß]{2,}\b", placed, spaced)


def _made(key: bytes):
    """A pandas UDF of (value, pii_type, attempt, entity)."""

    @F.pandas_udf("string")
    def make(value: pd.Series, kind: pd.Series, attempt: pd.Series, entity: pd.Series) -> pd.Series:
        return pd.Series([surrogate(v, k, key, int(n), e) for v, k, n, e in zip(value, kind, attempt, entity)], dtype=object)

    return make


def surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(pii_type, entity, surrogate, occurrences, attempt): one row per distinct entity, surrogates distinct within a type.

    Spellings of one entity share its surrogate. In every round each open entity makes its next attempt; it is settled unless
    the surrogate is taken already or a lesser entity has the same one in this round. Rounds go on until none is open; longer
    attempts make each round settle more.
    """
    make = _made(key)
    found = found.groupBy("pii_type", "entity").agg(F.count("*").alias("occurrences"), F.max_by("value", F.struct(F.length("value"), "value")).alias("sample"))
    state = cut(found.select("*", F.lit(None).cast("string").alias("surrogate"), F.lit(0).alias("attempt"), F.lit(False).alias("settled")))
    attempt = 0
    while not state.where("not settled").isEmpty():
        tried = state.where("not settled").withColumn("surrogate", make("sample", "pii_type", F.lit(attempt), "entity")).withColumn("attempt", F.lit(attempt))
        both = state.where("settled").unionByName(tried)
        holder = both.groupBy("pii_type", "surrogate").agg(F.min(F.struct(~F.col("settled"), "entity"))["entity"].alias("holder"))
        state = cut(both.join(holder, ["pii_type", "surrogate"]).withColumn("settled", F.col("entity") == F.col("holder")).drop("holder"))
        attempt += 1
    return state.select("pii_type", "entity", "surrogate", "occurrences", "attempt")


def rewritten(documents: DataFrame, lexicon: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, replaced) with every entity replaced by its surrogate, written as the occurrence is.

    The attempt that made an entity's surrogate distinct holds for all its occurrences; ``replaced`` counts them. Null and
    empty texts come out as they are, rows without doc_id too. A text's replacements are brought together by (doc_id, hash
    of the text); an entity of many occurrences is joined by its key, which AQE splits.
    """
    found = cut(entities(documents, lexicon))
    table = surrogates(found, key).select("pii_type", "entity", "attempt")
    make = _made(key)
    spans = (
        found.distinct().join(table, ["pii_type", "entity"]).withColumn("by", make("value", "pii_type", "attempt", "entity"))
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "by"))).alias("spans"))
    )
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key")).join(spans, ["doc_id", "text_key"], "left")
    between = lambda a, n: F.substring(F.col("text"), (a + 1).cast("int"), n.cast("int"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda s, e: F.struct(e["end_pos"].alias("at"), F.concat(s["out"], between(s["at"], e["start_pos"] - s["at"]), e["by"]).alias("out"))
    made = F.aggregate("spans", begin, step, lambda s: F.concat(s["out"], between(s["at"], F.length("text"))))
    return texts.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(made).alias("text"), F.coalesce(F.when(F.col("spans").isNotNull(), F.size("spans")), F.lit(0)).alias("replaced"))


def redacted(documents: DataFrame, lexicon: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text) with every entity replaced by a typed placeholder such as ``[NAME:4f2a91c0d3e7b658]``.

    The part after the colon is a keyed hash of the canonical value: the same in every document for the same entity, and
    64 bits wide, so that distinct entities stay distinct. Null and empty texts come out as they are.
    """
    names = _lexicon(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for batch in batches:
            texts = []
            for text in batch["text"].to_pylist():
                at, parts = 0, []
                found = finder.find(text) if text else []
                for (start, end, kind), entity in zip(found, coreferent(found, text or "")):
                    tag = hashlib.blake2b(f"{kind}|{entity}".encode(), key=key, digest_size=8).hexdigest()
                    parts += [text[at:start], f"[{kind.upper()}:{tag}]"]
                    at = end
                texts.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id long, text string")
