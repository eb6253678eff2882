"""Template residue and error-page text in documents."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from re import _compiler as compiler
from re import _constants as sre
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, read_table, spread

_NAME = r"[^\W\d][\w .-]*?"
_UNSET = r"(?:undefined|NaN|null|None|nil|none|unknown|N/A|\[object Object\])"

# Unfilled placeholders, by the marks of common template languages.
PLACEHOLDER = re.compile(
    rf"""
      \{{\{{\{{?\s*[#/&^]?\s*{_NAME}\s*(?:\|[^{{}}]*)?\}}\}}\}}?                  # {{{{name}}}}
    | [$#]\{{\s*{_NAME}\s*\}}                                                     # ${{name}} #{{name}}
    | (?<![\w"'$#{{])\{{\s*(?:{_NAME}|\d{{1,2}})\s*\}}(?!["'}}])                   # {{name}} {{0}}
    | <%[=-]?\s*{_NAME}\s*[-=]?%> | \{{%-?\s*{_NAME}\s*-?%\}}                     # <%= name %> {{% name %}}
    | %\(\s*{_NAME}\s*\)[sdf]                                                     # %(name)s
    | (?<![\w%])%[^\W\d](?:\w|[ ](?=\w))+%(?![A-Za-z0-9_%])                        # %NAME%
    | (?<![\w$])\$[^\W\d]\w+\$(?![A-Za-z0-9_$])                                    # $NAME$
    | @@\s*{_NAME}\s*@@                                                           # @@name@@
    | (?<!\w)__[^\W\d_](?:\w|[ ])*?__(?![A-Za-z0-9_])                                       # __NAME__
    | \[\[\s*{_NAME}\s*\]\]                                                       # [[name]]
    | «\s*{_NAME}\s*»님? (?=[,.의에님 ]|$)                                          # «name»
    | \[\s*(?:insert|enter|add|your|replace|type|fill\ in|put)\b[^\[\]]*\]       # [INSERT NAME]
    | <\s*(?:insert|enter|add|your)\s[^<>]+>                                   # <your name>
    | <\s*{_NAME}\s+(?:here|goes\ here)\s*>                                       # <name here>
    | \(\s*[^()]+\s(?:to\ be\ (?:added|filled\ in|provided|confirmed|announced)|goes\ here)\s*\)
    | (?<!\w)X{{3,}}(?![A-Za-z0-9_])                                       # XXXX
    """,
    re.X | re.I,
)

# Values that weren't set and were printed as text.
UNSET = re.compile(
    rf"""
      \[object\ Object\] | (?<!\w)NaN(?=[-/]NaN|[가-힣]|\W|$) | (?<!\w)undefined(?=[가-힣]|\W|$)
    | (?<!\w){_UNSET}\b\W+(?:\w+\W+){{0,4}}?{_UNSET}(?!\w)
    | ^\W*[^\W\d][\w ]{{0,30}}:\s*(?:null|None|nil)\W*$
    """,
    re.X,
)

# Filler in place of text.
FILLER = re.compile(
    r"""
      \blorem\s+ipsum\b | \bdolor\s+sit\s+amet\b
    | \b(?:placeholder|dummy|sample|filler)\s+(?:text|paragraph|caption|content|copy|title|description)\b | \bplatzhaltertext\b | \btexte?\s+(?:de\s+remplissage|provisoire|factice)\b | \btexto\s+(?:de\s+relleno|provisional)\b
    | ^\W*(?:your\s+)?(?:text|caption|title|content|description)\s+(?:goes\s+)?here\W*$ | \b(?:text|caption|title|content|description)\s+goes\s+here\b
    | \b(?:description|content|text|caption|title|more\ information)\s+(?:is\s+)?coming\s+soon\b | ^\W*coming\s+soon\W*$
    | ^\W*(?:replace|enter|insert|add|type)\s+(?:this|your|the|a|some|note|caption|title)?\s*(?:text|caption|title|note|description|content)\b
    | ^\W*untitled(?:\s+\w+)?\W*$ | (?:^|\W)(?:TODO|FIXME)\s*:\s*\w+ | ^\W*(?:TBD|TBA|TODO|FIXME|N/A)(?:\W+(?:TBD|TBA|TODO|FIXME|N/A))*\W*$ | \bTBD\.\s*TBD\b
    | ^\W*(?:asdf|qwer|zxcv)\w*(?:\W+(?:asdf|qwer|zxcv)\w*)*\W*$
    | ^\W*test\s+test\b
    | 임시\s*(?:문구|텍스트|내용) | (?:내용|설명|본문|페이지)\s*(?:이|은|을)?\s*준비\s*중 | (?:설명|제목|내용|문구|텍스트)[을를]?\s*(?:여기에\s*)?(?:입력|작성)하세요 | 여기에\s*\S+\s*(?:입력|작성) | 더미\s*텍스트
    """,
    re.X | re.I,
)

# The same word, or the same letter, over and over.
REPEATED = re.compile(
    r"""
      ^\W*([^\W\d_]\w{1,4})\W+(?=(?:(?:\1|\d+|qwer|asdf|zxcv|qwerty|jkl)\b\W*){2,}$)(?:\d+\W+)*(?:\1|qwer|asdf|zxcv|qwerty|jkl)\b
    | ^\W*([a-z])\2{2,}\W+([a-z])\3{2,}(?:\W+([a-z])\4{2,})*\W*$
    | (?<!\w)([a-z])\5{2,}\W+([a-z])\6{2,}\W+([a-z])\7{2,}(?!\w)
    | (?<!\w)(?:asdf|qwer|zxcv)\w*(?:\W+(?:asdf|qwer|zxcv)\w*){2,}
    """,
    re.X | re.I,
)

_SCRIPT = r"(?:java\s?script|scripts?|scripting|guión|자바스크립트|스크립트)"
# Notices that scripts, cookies or another browser are needed.
SCRIPT = re.compile(
    rf"""
      \b(?:enable|enabling|activate|allow|allowed|turn(?:ed)?\s+on|switch(?:ed)?\s+on|requires?|needs?|support(?:s|ed)?|activez|autoriser|activer|active|activar|habilite|aktivieren|erlauben|ativ[ae]r?)\b[^.!?]{{0,60}}\b{_SCRIPT}
    | \b{_SCRIPT}\b[^.!?]{{0,60}}\b(?:enabled|required|needed|disabled|allowed|switched\s+o(?:n|ff)|turned\s+o(?:n|ff)|aktivieren|désactivés?|requis|desactivado)\b
    | \bscript-enabled\b | \bscripts?\s+for\s+this\s+page\b | \bchecking\s+your\s+browser\b | <noscript\b
    | (?:자바스크립트|스크립트|JavaScript)[가-힣]*\s*(?:\S+\s+){{0,2}}?(?:켜|허용|꺼져|사용|활성화|필요)
    """,
    re.X | re.I,
)

# Messages of servers, viewers and programs.
_THING = r"(?:page|folder|album|file|image|gallery|link|content|resource|site|document|site|url|address|seite|página|pagina|pages?|ordner)"
ERROR = re.compile(
    rf"""
      ^\W*(?:https?\s+)?(?:error\s+)?[45]\d\d\b\W*(?:internal|bad|not\s+found|service|gateway|forbidden|unauthori[sz]ed|server|page|error|too\s+many)\b | \b(?:internal\s+server\s+error|bad\s+gateway|service\s+(?:temporarily\s+)?unavailable|gateway\s+time-?out)\b
    | \b{_THING}\b[^.!?]{{0,40}}\b(?:(?:was|were|is|could)\s+)?not\s+(?:be\s+)?(?:found|exist|available)\b | \b{_THING}\b[^.!?]{{0,40}}\b(?:does\s+not|doesn['’]t|no\s+longer)\s+(?:exist|available|be)\b | \b(?:is|are)\s+no\s+longer\s+available\b
    | \b(?:can['’]?t|cannot|could\s*n['’]t|could\s+not|unable\s+to)\s+(?:find|open|load|display|reach|connect)\s+(?:that|the|this|your|index|to)?\s*{_THING}
    | \blink\s+you\s+followed\b | \bmay\s+have\s+been\s+(?:moved|deleted|removed)\b | \b(?:has|have)\s+been\s+(?:moved\s+or\s+deleted|removed\s+or\s+deleted)\b
    | \baccess\s+(?:is\s+|was\s+)?denied\b | \byou\s+(?:need|don['’]t\s+have|do\s+not\s+have)\s+(?:the\s+)?permission\b | \bpermission\s+(?:is\s+)?(?:denied|required)\b | ^\W*forbidden\b | \brole\s+required\b | \bnot\s+authori[sz]ed\s+to\b
    | ^\W*log\s?in\s+required\b | \b(?:enter\s+your\s+account|sign\s+in|log\s+in)\b[^.!?]{{0,30}}\b(?:to\s+continue|again|to\s+see|to\s+view|required)\b | \bsession\s+(?:has\s+)?(?:expired|timed\s+out)\b
    | \bsomething\s+went\s+wrong\b | ^\W*oops\b | \btoo\s+many\s+requests\b | \bretry\s+(?:after|in)\s+\d+ | \btry\s+again\s+later\b | \bunder\s+maintenance\b | \bblocked\s+in\s+your\s+(?:area|country|region)\b
    | ^\W*error\s+\d+\s*: | \b(?:did\s+not|didn['’]t)\s+(?:answer|respond)\s+in\s+time\b | \btimed?\s*-?out\s+(?:while|after|waiting|fetching|reading)\b | \bupstream\s+timed\s+out\b | \bconnection\s+(?:to\s+[\w ]+\s+)?(?:was\s+)?(?:reset|refused|closed|lost)\b
    | \bunexpected\s+(?:end\s+of|token|response|error)\b | \btraceback\s+\(most\s+recent\s+call | ^\s*File\s+"[^"]+",\s+line\s+\d+ | ^\W*(?:\w+\.)*\w+(?:Error|Exception)\s*: | ^\s*at\s+[\w.$]+\([\w.]+:\d+\)
    | \{{\s*"?(?:error|code|status)"?\s*:\s*(?:\{{|\d{{3}}|"(?:error|fail)) | \bcode=\d+\s+msg= | \bmsg=\S+\s.*\b(?:unable|failed|error)\b
    | \bpágina\s+no\s+encontrada\b | \bno\s+se\s+(?:ha\s+)?(?:encontr|pudo|puede)\w*\s+\S+\s+(?:página|archivo|carpeta) | \berror\s+del\s+servidor\b | \bacceso\s+denegado\b
    | \bpage\s+(?:demandée\s+)?(?:est\s+)?introuvable\b | \berreur\s+(?:interne|du\s+serveur|\d{{3}}) | \baccès\s+(?:refusé|interdit)\b
    | \b(?:seite|datei|ordner)\s+(?:wurde\s+|konnte\s+)?nicht\s+gefunden\b | \bdienst\s+ist\s+(?:zurzeit\s+|derzeit\s+)?nicht\b | ^\W*fehler\s+\d+ | \bzugriff\s+verweigert\b
    | \bpágina\s+não\s+encontrada\b | \bacesso\s+negado\b
    | (?:페이지|폴더|파일|앨범|이미지)[을를이가]?\s*(?:찾을\s*수\s*없|열\s*수\s*없|불러올\s*수\s*없|존재하지\s*않) | (?:삭제되었거나|이동되었거나)\s*\S*(?:이동|삭제) | 서버\s*(?:오류|에러|응답)[가-힣]*\s*(?:가|이|시간)?\s*\S*(?:발생|초과) | (?:접근|열람|조회)\s*권한이?\s*없 | 잠시\s*후\s*다시\s*시도 | 관리자에게\s*문의 | 로그인이?\s*(?:후|필요|해\s*주) | 주소를\s*다시\s*확인 | 점검\s*중(?:입니다|이) | 시간이?\s*초과되었
    """,
    re.X | re.I,
)
# Of these a text may well speak; alone or repeated all over the collection they are messages.
WEAK = re.compile(r"\bsomething\s+went\s+wrong\b|\btry\s+again\s+later\b|\bretry\s+(?:after|in)\b|^\W*oops\b|\b(?:sign|log)\s*in\b|\bcoming\s+soon\b|\bmay\s+have\s+been\b|관리자에게\s*문의|주소를\s*다시\s*확인|로그인|점검\s*중", re.I)

# Whoever explains, quotes or depicts such text.
QUOTED = re.compile(r"“[^”]*”|‘[^’]*’|„[^“”]*[“”]|「[^」]*」|『[^』]*』|`[^`]+`|(?<![\w{:,\[=] )(?<![\w{:,\[=(])\"[^\"{}]+\"(?=[\s,.;:!?)])")
EXPLAINS = re.compile(
    r"""
      \b(?:token|placeholder|variable|tag|mark(?:er)?|template|field|string|code|status|message|word|words)s?\b[^.!?]{0,80}\b(?:stands?\s+for|means?|is\s+(?:replaced|filled|substituted|shown|written)|are\s+(?:replaced|filled)|gets?\s+(?:replaced|filled)|where\s+the|writes?|reads?|says?)\b
    | \b(?:stands?\s+for|is\s+replaced\s+(?:on|by|with)|replaced\s+on\s+save|explains?\s+that|explained\s+that|describes?\s+how|as\s+an\s+example|for\s+example|painted\s+as|readable\s+in|in\s+chalk)\b
    | \buses?\b[^.!?]{0,80}\bwhen\b | \btemplate\s+writes\b
    | 자리에\s*\S+\s*\S+이?\s*(?:들어|바뀌|표시)|라고\s*(?:설명|적혀|쓰여|적어|표시)|라는\s*(?:농담|문구|글|말|표시)[이가을를]?|뜻(?:한다|이다|으로)|설명한다|설명했다|의미한다
    """,
    re.X | re.I,
)
# Letters that patterns without regard to case take for others, beyond what lower() makes of them.
CASES = str.maketrans({"İ": "i", "ı": "i", "ſ": "s"})
UNLIKE = re.compile("[İıſ]")


def _folded(text: str) -> str:
    return text.lower() if text.isascii() or not UNLIKE.search(text) else text.translate(CASES).lower()


def _spelled(item, most: int = 48) -> set[str] | None:
    """All that a part of a parsed pattern can match, if that is little and has no spaces."""
    op, av = item
    if op is sre.LITERAL:
        return None if chr(av).isspace() else {_folded(chr(av))}
    if op is sre.IN:
        return {_folded(chr(x)) for _, x in av} if len(av) <= 4 and all(o is sre.LITERAL and not chr(x).isspace() for o, x in av) else None
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    if op is sre.SUBPATTERN:
        return _spelled_all(av[-1], most)
    if op is sre.BRANCH:
        each = [_spelled_all(x, most) for x in av[1]]
        return None if any(x is None for x in each) or len(found := set().union(*each)) > most else found
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[:2] == (0, 1):
        inner = _spelled_all(av[2], most)
        return None if inner is None else inner | {""}
    return None


def _spelled_all(items, most: int = 48) -> set[str] | None:
    out = {""}
    for item in items:
        if (more := _spelled(item, most)) is None or len(out) * len(more) > most:
            return None
        out = {a + b for a in out for b in more}
    return out


def needed(items) -> set[str] | None:
    """Strings without spaces of which all that a parsed pattern matches has one, lower-cased; the rarest such set, None if there is none."""
    sets, now = [], {""}
    for item in items:
        more = _spelled(item)
        if more is not None and len(now) * len(more) <= 48:
            now = {a + b for a in now for b in more}
            continue
        sets.append(now)
        now = more or {""}
        if more is None:
            op, av = item
            if op is sre.SUBPATTERN:
                sets.append(needed(av[-1]) or set())
            elif op is sre.BRANCH:
                each = [needed(x) for x in av[1]]
                sets.append(set().union(*each) if all(each) else set())
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[0]:
                sets.append(needed(av[2]) or set())
    sets = [x for x in (*sets, now) if x and "" not in x]
    return max(sets, key=lambda x: min(sum(1 if c.isalnum() and c.isascii() else 3 for c in w) for w in x)) if sets else None


def alternatives(pattern: re.Pattern) -> list[tuple[re.Pattern, set[str] | None]]:
    """The alternatives of a pattern as patterns of their own, and strings of which every match of each has one (None: it needs none)."""
    parsed = parser.parse(pattern.pattern, pattern.flags)
    parts = parsed[0][1][1] if len(parsed) == 1 and parsed[0][0] is sre.BRANCH else [parsed]
    return [(compiler.compile(x, pattern.flags), needed(x)) for x in parts]


def literals(pattern: re.Pattern) -> set[str] | None:
    """Strings of which every match of a pattern has one; None if one of its alternatives needs none."""
    each = [words for _, words in alternatives(pattern)]
    return set().union(*each) if all(each) else None


@functools.cache
def _automaton():
    """The alternatives of all kinds in order, (kind, pattern, whole pattern), and a function that tells which of them (as bits) may match a folded text: those with a needed string in it and those without such strings."""
    found: dict[str, int] = {}
    always, parts = 0, []
    for kind, pattern in KINDS:
        for part, words in alternatives(pattern):
            if words is None:
                always |= 1 << len(parts)
            for x in words or ():
                found[x] = found.get(x, 0) | 1 << len(parts)
            parts.append((kind, part, pattern))
    try:
        import ahocorasick
    except ImportError:
        return parts, lambda text: always | _any_of(text, found)
    machine = ahocorasick.Automaton()
    for x, bits in found.items():
        machine.add_word(x, bits)
    machine.make_automaton()

    def bits_of(text: str) -> int:
        bits = always
        for _, more in machine.iter(text):
            bits |= more
        return bits

    return parts, bits_of


def _any_of(text: str, found: dict[str, int]) -> int:
    bits = 0
    for x, more in found.items():
        if more & ~bits and x in text:
            bits |= more
    return bits


SEGMENT = re.compile(r"(?<=[.!?。…])\s+|\n+|(?<=[.!?])(?=<)")
MARKUP = re.compile(r"</?(?:p|b|i|em|strong|span|div|h\d|br|html|head|body|title|li|ul|td|tr|table)(?:\s[^<>]*)?/?>|\*\*|&nbsp;", re.I)
INLINE = re.compile(r"</?(?:b|i|em|strong|span)\b|\*\*|&nbsp;", re.I)
DIGITS = re.compile(r"\d+")
TERM = re.compile(r"[^\W\d_]{3,}")
WORDS = re.compile(r"[^\W\d_]{2,}")
PLAIN = re.compile(r"(?<![^\W\d_])[a-z]{2,}(?![^\W\d_])")  # words in plain letters
KINDS = (("placeholder", PLACEHOLDER), ("unset", UNSET), ("filler", FILLER), ("filler", REPEATED), ("script", SCRIPT), ("error", ERROR))


def split(text: str) -> list[str]:
    """The sentences and lines of a text, without markup."""
    if "<" in text or "*" in text or "&" in text:
        text = MARKUP.sub(lambda m: " " if INLINE.match(m[0]) else "\n", text)
    return [x for x in SEGMENT.split(text) if x]


def segments_of(text: str):
    """(kind, weak, segment) for each sentence or line of a text; the kind is None without residue, or where residue is explained or quoted."""
    parts, bits_of = _automaton()
    for segment in split(text):
        bits = bits_of(_folded(segment))
        bare = QUOTED.sub(" ", segment) if bits else segment
        found = None
        while bits:
            bit = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            kind, part, pattern = parts[bit]
            if part.search(bare):
                if not EXPLAINS.search(segment):
                    found = (kind, bool(kind in ("error", "filler") and WEAK.search(bare) and not pattern.search(WEAK.sub(" ", bare))), segment.strip())
                break
        yield found or (None, False, segment.strip())


def residue_segments(text: str):
    """(kind, weak, segment) for each sentence or line of a text that holds residue and doesn't explain or quote it."""
    return (x for x in segments_of(text) if x[0])


def trigrams(word: str) -> list[str]:
    """Three letters in a row of a word, its ends being letters of their own."""
    word = f"^{word}$"
    return [word[k : k + 3] for k in range(len(word) - 2)]


class Likeness:
    """How much more likely words are as filler than as content, in nats, from the letter trigrams of either.

    ``counts`` has (filler, content) by trigram: at most 28**3 entries, whatever the collection. Filler counts as
    ``prior`` trigrams of the whole collection more than were seen, so that without known filler nothing is like it.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], prior: float = 100.0):
        filler = sum(f for f, _ in counts.values())
        both = sum(f + c for f, c in counts.values()) + 0.5 * (len(counts) + 1)
        self._of = {g: math.log((f + prior * (share := (f + c + 0.5) / both)) / (filler + prior) / share) for g, (f, c) in counts.items()}
        self._unseen = math.log(prior / (filler + prior))
        self._words: dict[str, float] = {}

    def word(self, word: str) -> float:
        if (known := self._words.get(word)) is None:
            if len(self._words) > 500_000:  # a memo, no limit on what is compared
                self._words.clear()
            known = self._words[word] = sum(self._of.get(g, self._unseen) for g in trigrams(word))
        return known

    def __call__(self, segment: str, least_words: int = 5) -> float:
        """The sum over the words of a segment; minus infinity if they are fewer, nor is it above 0 if a fifth of them or more aren't in plain letters."""
        plain = PLAIN.findall(low := segment.lower())
        if len(plain) < least_words:
            return -math.inf
        total = sum(map(self.word, plain))
        return total if total <= 0 or len(plain) > 0.8 * len(WORDS.findall(low)) else -math.inf


def _subject(text: str, host: str | None) -> tuple[str, set[str]]:
    """The title of a document, its first line, and the terms of its address and title."""
    first = text.lstrip().split("\n", 1)[0]
    return first, set(TERM.findall((host or "").lower().replace("_", " "))) | set(TERM.findall(first.lower()))


_FOUND = (("doc_id", None), ("kind", pa.string()), ("weak", pa.bool_()), ("mask", pa.string()), ("apart", pa.bool_()), ("share", pa.float64()), ("host", pa.string()), ("filler", pa.int64()), ("content", pa.int64()))


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", least_hosts: int = 2, least_likeness: float = 3.0) -> DataFrame:
    """Documents with residue where content should be: (doc_id, kinds, segments, share, evidence).

    ``kinds`` are the kinds found (error, filler, placeholder, script, unset), sorted; ``segments`` how many
    sentences or lines hold residue; ``share`` the part of the text's characters that they make up; ``evidence``
    what decided, sorted: 'detector', 'hosts' or 'terms'.

    Each sentence or line goes through detectors for unfilled placeholders, unset values, filler, script
    notices and error messages, after quoted and code-like stretches are taken out; sentences that explain or
    depict such text don't count. What a text may well say itself (to sign in, to try again) counts on
    combined evidence only: the sentence shares no term with the address of its document and with its title, the
    first line, and it is all there is, or comes with certain residue, or recurs, numbers aside, in documents of
    ``least_hosts`` hosts or more. Sentences are counted by their hash, over the whole collection.

    Sentences without residue, of five words or more, are compared with the filler that the detectors found
    anywhere: those that share no term with their address and title and whose words are made like those of
    filler, rather than like those of all other sentences, are filler too ('terms'). The letter trigrams of all
    words are counted, which gives at most 28**3 numbers; ``least_likeness`` is the least log-likelihood ratio. In
    collections without known filler no sentence is found so.

    Null ids, null and empty texts have no rows; a null host counts as one host. Rows of the same id give one
    row. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host.alias("host")).filter("doc_id is not null and text <> ''")
    id_type = dict(rows.dtypes)["doc_id"]

    def detect(batches):
        for b in batches:
            out: list[tuple] = []
            at: list[int | None] = []
            filler, content = Counter(), Counter()
            for k, (text, host) in enumerate(zip(b.column("text").to_pylist(), b.column("host").to_pylist())):
                found = list(residue_segments(text))
                content.update(PLAIN.findall(text.lower()))
                if not found:
                    continue
                first, about = _subject(text, host)
                for kind, unsure, segment in found:
                    low = segment.lower()
                    content.subtract(words := PLAIN.findall(low))
                    if kind == "filler":
                        filler.update(words)
                    at.append(k)
                    out.append((kind, unsure, DIGITS.sub("0", segment), segment in first or about.isdisjoint(TERM.findall(low)), len(segment) / len(text), host or "", None, None))
            grams: dict[str, list[int]] = {}
            for place, counts in enumerate((filler, content)):
                for word, n in counts.items():
                    if n > 0:
                        for g in trigrams(word):
                            grams.setdefault(g, [0, 0])[place] += n
            for g, n in grams.items():
                at.append(None)
                out.append((None, None, g, None, None, None, *n))
            cols = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(cols, _FOUND[1:]))], names=[n for n, _ in _FOUND])

    schema = f"doc_id {id_type}, kind string, weak boolean, mask string, apart boolean, share double, host string, filler long, content long"
    marked = rows.mapInArrow(detect, schema)
    # a row for each piece of residue, and one for each trigram of a task
    marked = cut_lineage(marked.select("doc_id", "kind", "weak", "apart", "share", F.when(F.col("kind").isNull(), F.col("mask")).alias("gram"), F.xxhash64("mask").alias("mask"), F.xxhash64("host").alias("host"), "filler", "content"))
    counts = marked.filter("kind is null").groupBy("gram").agg(F.sum("filler").alias("filler"), F.sum("content").alias("content")).collect()  # at most 28**3 rows
    table = {r["gram"]: (r["filler"], r["content"]) for r in counts}

    def compare(batches):
        like = Likeness(table)
        for b in batches:
            at, share = [], []
            for k, (text, host) in enumerate(zip(b.column("text").to_pylist(), b.column("host").to_pylist())):
                if sum(x for w in PLAIN.findall(text.lower()) if (x := like.word(w)) > 0) < least_likeness:
                    continue  # nor can the sum of any sentence be more
                if not any(like(x) >= least_likeness for x in split(text)):
                    continue
                first, about = _subject(text, host)
                for kind, _, segment in segments_of(text):
                    if kind is None and like(segment) >= least_likeness and (segment in first or about.isdisjoint(TERM.findall(segment.lower()))) and like(QUOTED.sub(" ", segment)) >= least_likeness:
                        at.append(k)
                        share.append(len(segment) / len(text))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(share, pa.float64())], names=["doc_id", "share"])

    found = marked.filter("kind is not null")
    # weak sentences need evidence: one row for each sentence and host, then hosts for each sentence
    hosts = found.filter("weak").groupBy("mask", "host").agg(F.lit(1).alias("one")).groupBy("mask").agg(F.count("*").alias("hosts"))
    if table:
        like = rows.mapInArrow(compare, f"doc_id {id_type}, share double").select("doc_id", F.lit("filler").alias("kind"), "share", F.lit(True).alias("sure"), F.lit("terms").alias("evidence"))
    sure = ~F.col("weak") | (F.col("apart") & ((F.col("share") > 0.5) | (F.col("hosts") >= least_hosts)))
    judged = found.join(hosts, "mask", "left").select("doc_id", "kind", "share", sure.alias("sure"), F.when(F.col("weak"), "hosts").otherwise("detector").alias("evidence"))
    by_doc = (judged.unionByName(like) if table else judged).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.count("*").alias("segments"),
        F.least(F.lit(1.0), F.round(F.sum("share"), 6)).alias("share"),
        F.max("sure").alias("sure"),
        F.array_sort(F.collect_set(F.when(F.col("sure"), F.col("evidence")))).alias("evidence"),
    )
    return by_doc.filter("sure").drop("sure")


def without_residue(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``df`` without the documents that :func:`residue` finds."""
    return df.join(residue(df, id_col, **options).select(F.col("doc_id").alias(id_col)), id_col, "left_anti")


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Documents with unfilled placeholders, unset values, filler, error messages or script notices."""
    return residue(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))).select("doc_id")
