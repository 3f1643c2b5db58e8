"""Template residue and error pages among documents (problem 8).

Normalised lines are counted by host. Content lines that recur there are
boilerplate and leave the residual; titles, menus and foot lines are set
aside too. What is left of a document is weighed sentence by sentence: if
more than half of its characters are unfilled template fields with their
frame, filler, error messages or notices that scripts, cookies or another
browser are needed, the document is residue. Lines that recur almost only in
such documents are learnt as evidence and the verdicts are given again.

Evidence is known by its form and by composition, never by whole sentences: a
field by its syntax, an error by a thing of the web together with its not
being there (:mod:`.cues`), filler by repetition, keyboard runs and pseudo-Latin.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship, small
from . import cues
from .cues import fold

#: A line is boilerplate of its host if this many of its documents, and this share of them, have it.
RECURS_DOCS, RECURS_SHARE = 3, 0.005

#: A recurrent line is learnt as evidence if this share of its documents is residue by other lines.
LEARNT_SHARE = 0.8

#: Bytes of a row of a table of lines when broadcast.
LINE_BYTES = 40

# Forms of unfilled fields.
FIELD = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\$\{[^{}\n]{1,60}\}|\$\([A-Za-z_][\w.]{1,40}\)|<%[^%\n]{0,80}%>|<\?(?:php|=)?[^?\n]{0,120}\?>|\{%[^%\n]{0,80}%\}|\[\[[^\[\]\n]{1,60}\]\]"
    r"|<<[^<>\n]{1,60}>>|(?-i:«(?:[A-Z][a-z0-9]+(?:[A-Z]\w*)+|\w+_\w+)»)|@@[\w. ]{1,60}@@|(?<![\w@])@[a-z_]\w{1,40}@(?!\w)|%%[A-Za-z_]\w{0,40}%%|%[A-Za-z][\w.]{2,40}%|%[A-Z]%|__[A-Za-z][\w. ]*?__|#[A-Za-z_][\w.]{0,40}#"
    r"|\{[A-Za-z_][\w. ]{1,40}\}|(?<![\w}\\$#%{])\{[A-Za-z]\}|\|\*[\w. ]{2,40}\*\|?|\*\|[\w. ]{2,40}\|\*|::[A-Za-z_]\w{1,40}::"
    r"|\[(?:[^\[\]\n]{0,60}\s)?(?:goes here|here|tbd|tba|tbc|folgt|einfugen|hier|ici|a completer|aqui|pendiente|insert)\]|\[(?:insert|add|your|enter|einfugen|inserer|insertar|ihr|votre|su)\s[^\[\]\n]{1,60}\]"
    r"|<(?:insert|add|your|enter|put|ihr|ihre|votre|su|tu|hier|ici)\s[^<>\n]{1,60}>|<[^<>\n]{1,50}\s(?:here|goes here|tbd|ici|hier|aqui)>|\[[A-Z][A-Z0-9_. -]{2,40}\]"
    r"|#(?:foreach|end|if|else|set)\b(?:\([^()\n]*\))?|<!--\s*(?:BEGIN|END|INCLUDE|#)\b[^\n]{0,60}?-->",
    re.I,
)
#: Single words in guillemets: fields of a letter if there are several in a short sentence or after a greeting, else quotations.
MERGE = re.compile(r"«[A-Z][a-z]\w{0,30}»")
#: What a field begins with.
_OPEN = re.compile(r"[{\[<@$«%_#|*:]")
CONTROL = re.compile(r"^\W*(?:\{%.*%\}|<\?.*\?>|\{\{[#/^>!].*\}\}|#(?:foreach|end|if|else|set)\b.*|<!--.*-->)\W*$", re.I)
_GAP = r"tb[dac]|fixme|n\.n\.|n/a|n\.a\.|x{3,8}|\?{3,8}|_{3,20}|\.{3,15}|…+|\[\s*\]|<\s*>|\{\s*\}"
MISSING = re.compile(rf"^[\s>*•-]{{0,3}}(?:{_GAP})(?:[\s,/|;!]{{1,3}}(?:{_GAP})){{0,60}}[\s.!?,;]{{0,3}}$", re.I)
MISSING_VALUE = re.compile(rf"^(.{{1,40}}?)\s*(?:[:=]|\s-\s)\s*(?:{_GAP})\W{{0,2}}$", re.I)
MISSING_WORD = re.compile(r"(?<!\w)(?:tb[dac]|n\.n\.|x{3,8}|\?{3,8}|_{3,20}|(?<!\.)\.{6,12}(?!\.))(?!\w)", re.I)
LABEL = re.compile(r"^\W*[^\W\d][\w .]{0,30}\s*(?:[:=#]|\s-\s)\s*\S.{0,40}$")
REFERENCE = re.compile(r"^\W*(?:[^\W\d_]+\W+){0,3}(?=[\w.:/-]*\d)[\w.:/-]{3,}\W*(?:\w+\W*){0,3}$")
# Forms that programs and servers give their messages.
_CODE = "|".join(cues.CODES.split())
CODE = re.compile(rf"^\W*(?:\w+\W+){{0,1}}?(?:{_CODE})\b(?P<rest>.{{0,60}})$|^\W*(?:\w+\W+){{0,3}}?(?:error|status|code|http|https?/\d(?:\.\d)?|failure|fehler|erreur|errore?|erro|fout|fel|blad|chyba|hiba|hata)\W{{0,3}}(?:code\W{{0,3}})?\d{{3,5}}\b", re.I)
# Reasons that go with status codes.
REASON = re.compile(r"^\W*(?:$|(?:error|not found|forbidden|unauthori[sz]ed|bad (?:gateway|request)|gone|oops|whoops|sorry|too many|internal server|(?:service |temporarily )?unavailable|(?:gateway |request )?time-?d?[ -]?out|access denied)\b)", re.I)
NUMBERED = re.compile(r"\b(?:code|codigo|error|ref\w*|id|incident\w*|vorgang)\W{0,3}[0-9a-f]*\d", re.I)
TRACE = re.compile(
    r"\b(?:undefined|null) is not an? |\bis not a function\b|\bis not defined\b|\bcannot read propert|traceback \(most recent|^\s*at [^\s(]+\([^()\n]*(?:\.\w+:\d+|native|unknown)[^()\n]*\)|^\s*file \".{1,200}\", line \d|\w(?:Error|Exception)\b(?::|\(|$| (?:at|in|on) )|\bat line \d+|\bon line \d+\W*$|\bora-\d{3,}|\berrno \d+|exit(?:ed with)? (?:code|status) \d|core dumped|stack ?trace"
    rf"|<title>\s*(?:{_CODE})\b|<h\d>\s*(?:{_CODE})\b"
    r"|\{\s*\"?error\"?\s*:|\"(?:status|code)\"\s*:\s*\"?[45]\d\d|\berr_\w+|^\s*<div id=\"(?:root|app)\">\s*</div>|<noscript|<script\b",
    re.I,
)
FOOT = re.compile(r"^\W*(?:©|\(c\) |&copy;|copyright\b|all rights reserved|alle rechte vorbehalten|tous droits|todos los derechos|powered by|impressum)", re.I)
HEADING = re.compile(r"^\s*#{1,6}\s\S.{0,60}$|^\s*={2,}\s*\S.{0,60}$|^\s*\S{1,30} (?:—|§|v\d+|run|log|notes)\s*\d*\s*$", re.I)
QUOTES = re.compile(r"“[^“”\n]*”|„[^“”„\n]*[“”]|«[^«»\n]*»|‘[^‘’\n]*’|(?<!\w)'[^'\n]{1,80}'(?!\w)|(?<![\w=])\"[^\"\n]{1,80}\"(?!\w)")
WORD = re.compile(r"\w+", re.U)
TAG = re.compile(r"</?(?:p|br|div|span|b|i|em|strong|a|li|ul|ol|td|tr|table|body|html|head|h[1-6]|nav|footer|header|section)\b[^<>]{0,80}>", re.I)
SPACES, DIGITS = "\t ", "123456789"
_ALIKE = str.maketrans(SPACES + DIGITS, " " * len(SPACES) + "0" * len(DIGITS))
_SENTENCE = re.compile(r"(?<=[.!?;])(?<!\bn\.[na]\.)\s+|(?<=[。！？])")
# Characters that end a line or a sentence, those that do before a blank, and blanks.
_CUT_CODES = [ord(c) for c in "\0\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029。！？"]
_STOP_CODES, _BLANK_CODES = [ord(c) for c in ".!?;"], [ord(c) for c in " \0\n\r\t\v\f\x1c\x1d\x1e\x1f\x85\u2028\u2029"]
#: Texts of this many bytes that do not pack to this share of them hold no filler by repetition that could outweigh the rest.
SHORT_BYTES, PACKS_TO = 256, 0.5

#: What divides the parts that :func:`repeats` compares, and their words.
PARTS, BLANKS = r"[.!?;,]*[ \t]*[\n\r]+[ \t]*|[.!?;]+[ \t]+", r"[ \t]+"
_PARTS, _BLANKS = re.compile(PARTS), re.compile(BLANKS)
_GAPS = re.compile("[ \\t\u00a0]{2,}|[\\t\u00a0]")
_BARS = re.compile(r"\s*[|·•›»]\s*")
SKIP, CONTENT, TEMPLATE, FRAME, FILLER, FAULT, NOTICE, SUPPORT = range(8)
KINDS = {TEMPLATE: "template", FRAME: "template", FILLER: "filler", FAULT: "error", NOTICE: "script"}


def _repeats(words: list[str]) -> bool:
    """Whether there are few different words for their number."""
    return len(words) >= 8 and len(set(words)) <= (2 if len(words) < 12 else max(3, len(words) // 6))


def _periodic(words: list[str]) -> bool:
    """Whether a few words come again and again in the same order."""
    return any(len(words) % k == 0 and len(words) // k >= 3 and words == words[:k] * (len(words) // k) for k in range(1, 7))


def _pseudo(words: list[str]) -> bool:
    """Filler by its words: half or more are pseudo-Latin, keyboard runs or empty words, and at least three."""
    known = sum(cues.is_filler_word(w) for w in words)
    return known >= 3 and known + sum(w.isdigit() for w in words) >= 0.5 * len(words)


def _wordy(low: str) -> int:
    """Words of a sentence; scripts without spaces count three letters as a word."""
    return sum(max(1, len(w) // 3) if ord(w[0]) >= 0x0E00 else 1 for w in WORD.findall(low))


def _fields(sentence: str) -> list[int]:
    """Lengths of the fields of a sentence."""
    found, last = [], 0
    for m in _OPEN.finditer(sentence):
        if m.start() >= last and (field := FIELD.match(sentence, m.start())):
            last = field.end()
            found.append(last - m.start())
    return found


def sentence_kind(sentence: str, has: int | None = None, filler: int = 0) -> int:
    """What one sentence (folded) is, looked at alone; ``has`` and ``filler`` are the bits of its cues and those of filler where they are known."""
    low = sentence.lower()
    found = None
    if has is None:
        found, has = cues.of(low), 0
        for _, bits in found:
            has |= bits
            filler += bits & cues.FILL > 0
    absent = has & cues.BAD or (has & cues.NOT and has & cues.THERE)
    if has & cues.FIELD:
        if CONTROL.match(sentence):
            return TEMPLATE
        fields = _fields(sentence)
        if len(fields) >= 2 or (fields and sum(fields) >= 0.2 * len(sentence)):
            return TEMPLATE
        merged = len(MERGE.findall(sentence))
        if merged and len(sentence) <= 80 and (merged >= 2 or cues.is_greeting(WORD.findall(low))):
            return TEMPLATE
    if has & cues.BLANK and (MISSING.match(sentence) or MISSING_VALUE.match(sentence) or len(MISSING_WORD.findall(sentence)) >= 2):
        return TEMPLATE
    if has & cues.MESSAGE and TRACE.search(sentence):
        return FAULT
    if filler >= 3 and _pseudo(WORD.findall(low)):
        return FILLER
    needed = has & cues.SCRIPT and (has & cues.NEED or (has & cues.NOT and has & cues.WITHOUT))
    if not has & (cues.NOUN | cues.PART | cues.DUMMY | cues.ERROR | cues.AGAIN | cues.MARK) and not needed and not absent:
        return CONTENT
    words = WORD.findall(low)
    if has & (cues.NOUN | cues.PART) and cues.is_layout(words) or has & (cues.NOUN | cues.DUMMY) and _periodic(words):
        return FILLER
    mentioned = [m.group() for m in QUOTES.finditer(sentence) if " " in m.group().strip()]
    if mentioned and len(words) - sum(len(WORD.findall(m)) for m in mentioned) >= 3:
        return CONTENT  # it tells of a quoted piece
    found = cues.of(low) if found is None else found
    n = _wordy(low)
    if n <= 12 and has & cues.GAP and has & cues.NOUN or n <= 8 and has & cues.DUMMY:
        return FILLER
    if needed and n <= 30:
        return NOTICE
    if n <= 14 and has & (cues.MESSAGE | cues.ERROR) and (code := CODE.search(sentence)) and (code["rest"] is None or REASON.match(code["rest"]) or has & (cues.ERROR | cues.BAD)):
        return FAULT
    if has & cues.ERROR:
        first = min(at for at, bits in found if bits & cues.ERROR)
        if has & cues.OCCUR or n <= 4 or (has & cues.THING and first <= 4 and n <= 12) or (first <= 12 and re.match(r"\W*(?:\w+\s+)?\w+(?:\s*\d+)?\s*[:!–-]", low)):
            return FAULT
    if has & cues.THING and absent and n <= 30:
        things = len({at for at, bits in found if bits & cues.THING}) + sum(bits & cues.WEB > 0 for _, bits in found)
        if things + bool(has & (cues.YOU | cues.SORRY | cues.AGAIN)) + (n <= 9) + bool(NUMBERED.search(low)) >= 2:
            return FAULT
    if absent and n <= 14:
        # an apology, or no subject at all: a page speaks
        begin = [bits for at, bits in found if at <= 4]
        if any(bits & cues.SORRY for bits in begin) or (n <= 8 and any(bits & cues.NOT for at, bits in found if at <= 1) and has & cues.THERE):
            return FAULT
    if has & cues.AGAIN and n <= 25:
        return SUPPORT
    return CONTENT


def _split(text: str) -> list[tuple[int, str, str]]:
    """``(line number, sentence, line)`` of non-empty lines, without mark-up scraps and folded."""
    if "<" in text or "&" in text:
        text = html.unescape(html.unescape(text))
        text = TAG.sub(" ", text) if not re.search(r"<title>|<h1>", text, re.I) else text
    out = []
    for at, raw in enumerate(fold(text).splitlines()):
        line = " ".join(raw.split())
        if line:
            out.extend((at, s, line) for s in _SENTENCE.split(line) if s)
    return out


def _phrase(sentence: str) -> str:
    return sentence.lower().strip(" .!?,;")


def _menu(line: str) -> bool:
    """Whether a line is a foot line, a link of a menu or a row of such links."""
    if FOOT.search(line) or (len(line) <= 60 and cues.is_menu(WORD.findall(line.lower()))):
        return True
    bars = sum(line.count(c) for c in "|·•›»")
    if bars < 2 or len(line) > 64 * (bars + 1):  # some part is too long for a link
        return False
    parts = _BARS.split(line.strip(" |·•›»"))
    return len(parts) >= 3 and all(0 < len(p) <= 60 for p in parts) and all(0 < len(WORD.findall(p)) <= 3 for p in parts) and not any(c.isdigit() for c in line)


def kinds_of(text: str, again: bool | None = None) -> list[tuple[int, str, int]]:
    """``(line number, sentence, kind)`` of a text in order; ``again`` is :func:`repeats` where that is known."""
    again = repeats(text) if again is None else again
    split = _split(text)
    menus = {at for at, line in {at: line for at, _, line in split}.items() if _menu(line)}
    kinds = [SKIP if at in menus else sentence_kind(sentence) for at, sentence, _ in split]
    if again:
        for i, (_, sentence, _) in enumerate(split):
            if kinds[i] == CONTENT and len(sentence) >= 15 and _repeats(WORD.findall(sentence.lower())):
                kinds[i] = FILLER
    # one short phrase over and over is filler
    content = [i for i, k in enumerate(kinds) if k in (CONTENT, SUPPORT) and len(split[i][1]) < 60]
    same = Counter(_phrase(split[i][1]) for i in content)
    for i in content:
        if same[_phrase(split[i][1])] >= 3 and any(c.isalpha() for c in split[i][1]):
            kinds[i] = FILLER
    pages = [k in (FAULT, NOTICE) for k in kinds]
    near = [any(pages[max(0, i - 2) : i + 3]) for i in range(len(kinds))]
    gaps = [i for i, k in enumerate(kinds) if k == CONTENT and MISSING_WORD.search(split[i][1])]
    if len(gaps) >= 3 or gaps and TEMPLATE in kinds:  # single gaps in several sentences
        for i in gaps:
            kinds[i] = TEMPLATE
    fields = sum(k == TEMPLATE for k in kinds)
    notices = NOTICE in kinds
    for i, k in enumerate(kinds):
        sentence = split[i][1]
        if k == SUPPORT:  # what to do about an error counts beside one, or alone
            kinds[i] = FAULT if any(pages) or all(x in (SKIP, SUPPORT, FAULT) for x in kinds) else CONTENT
        elif k in (CONTENT, FAULT) and fields >= 2 and (LABEL.match(sentence) or cues.is_greeting(WORD.findall(sentence.lower()))):
            kinds[i] = FRAME  # the frame of unfilled fields: labelled values and greetings around them
        elif k == CONTENT and notices and cues.asks(sentence.lower()) and _wordy(sentence.lower()) <= 12:
            kinds[i] = NOTICE  # what to do about it
        elif k == CONTENT and near[i] and len(sentence) <= 60 and (LABEL.match(sentence) or REFERENCE.match(sentence)):
            kinds[i] = FAULT
        elif k == CONTENT and ((len(sentence) <= 80 and HEADING.match(sentence)) or (i == 0 and len(split) > 1 and len(sentence) <= 40 and len(sentence.split()) <= 4 and sentence == split[i][2] and sentence[-1].isalnum())):
            kinds[i] = SKIP
    return [(at, sentence, kind) for (at, sentence, _), kind in zip(split, kinds)]


def weigh(text: str) -> tuple[int, Counter]:
    """Characters of the residual, before recurrent lines leave it, and those of evidence by kind."""
    weight, residual = Counter(), 0
    for _, sentence, kind in kinds_of(text):
        if kind != SKIP:
            residual += len(sentence)
            if kind in KINDS:
                weight[KINDS[kind]] += len(sentence)
    return residual, weight


def may_hold_evidence(text: str) -> bool:
    """Whether a closer look is needed; never False for a text that :func:`weigh` finds evidence in."""
    return bool(_look([text])[0]) or repeats(text)


def repeats(text: str) -> bool:
    """Whether a text repeats lines, sentences or words so much that it may be filler: it is short or packs well, and few of its parts differ."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) >= SHORT_BYTES and len(zlib.compress(raw, 1)) > PACKS_TO * len(raw):
        return False
    parts = _PARTS.split(text.lower() + "\n")
    phrases = [p for p in (p.strip() for p in parts) if 0 < len(p) < 60]
    if len(phrases) - len(set(phrases)) >= 2:
        return True
    return any(_few(_BLANKS.split(p.strip())) for p in parts)


def _few(words: list[str]) -> bool:
    return len(words) >= 8 and 4 * len(set(words)) <= max(8, len(words))


def _look(texts: list[str]) -> np.ndarray:
    """Which texts have cues of evidence, from one search over all of them; repetition is looked for apart."""
    marked = np.zeros(len(texts), bool)
    if not texts:
        return marked
    plain = (html.unescape(html.unescape(t)) if "&" in t else t for t in texts)
    joined = "\0".join(fold(t.replace("\0", " ") if "\0" in t else t) for t in plain)
    cased = _GAPS.sub(" ", joined)
    joined = cased.lower()
    if len(joined) != len(cased):  # a letter that takes more room in lower case
        cased = joined
    code = cues.codes_of(joined)
    ends = np.flatnonzero(code == 0)
    at, bits = cues.hits(joined)
    if not len(at):
        return marked
    # cues of one sentence count together
    blank = np.isin(code, _BLANK_CODES)
    stop = np.isin(code, _STOP_CODES) & np.r_[blank[1:], True]
    cut = np.r_[-1, np.flatnonzero(np.isin(code, _CUT_CODES) | stop), len(joined)]
    place = np.searchsorted(cut, at, side="right")
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    has = np.bitwise_or.reduceat(bits, starts)
    filler = np.add.reduceat((bits & cues.FILL > 0).astype(np.int64), starts)
    short = cut[np.minimum(place[starts], len(cut) - 1)] - cut[place[starts] - 1] <= 80
    any_of = lambda flag: (has & flag) > 0
    worth = (any_of(cues.THING) | short) & (any_of(cues.BAD) | (any_of(cues.NOT) & any_of(cues.THERE)))
    worth |= (any_of(cues.SCRIPT) & (any_of(cues.NEED) | any_of(cues.WITHOUT))) | (any_of(cues.SORRY) & (any_of(cues.BAD) | any_of(cues.THERE))) | (any_of(cues.GAP) & any_of(cues.NOUN)) | any_of(cues.ERROR | cues.AGAIN | cues.DUMMY | cues.MARK) | (filler >= 1) & short | (filler >= 3) | (any_of(cues.NOUN | cues.PART) & short)
    for k in np.flatnonzero(worth):
        doc = np.searchsorted(ends, at[starts[k]])
        if not marked[doc]:
            sentence = cased[cut[place[starts[k]] - 1] + 1 : cut[min(place[starts[k]], len(cut) - 1)] + 1].strip("\0 \n\r")
            known = (None, 0) if "<" in sentence else (int(has[k]), int(filler[k]))
            marked[doc] = sentence_kind(TAG.sub(" ", sentence) if "<" in sentence else sentence, *known) != CONTENT
    return marked


ROW_KEY = "xxhash64(doc_id, source, text) AS row_key"


def normal(line: str) -> str:
    """A line as it is counted: lower case, digits alike, no doubled or outer spaces."""
    return line.translate(_ALIKE).strip(" ").replace("  ", " ").lower()


def lines_of(documents: DataFrame) -> DataFrame:
    """``(row_key, source, line, size)``: the different lines of every document, normalised, as hashes with their length.

    All lines count, whatever their length. ``row_key`` is a hash of the
    row; a null ``source`` stays null.
    """
    text = F.lower(F.replace(F.translate("text", SPACES + "\r" + DIGITS, " " * len(SPACES) + "\n" + "0" * len(DIGITS)), F.lit("  "), F.lit(" ")))
    lines = F.explode(F.array_distinct(F.split(text, "\n"))).alias("l")
    rows = documents.where("text IS NOT NULL").select(F.expr(ROW_KEY), F.lower(F.trim("source")).alias("source"), lines).withColumn("l", F.trim("l"))
    return rows.where("l <> ''").select("row_key", "source", F.xxhash64("l").alias("line"), F.length("l").cast("bigint").alias("size"))


def line_counts(lines: DataFrame) -> DataFrame:
    """``(source, line, docs)``: in how many documents of a host each of ``lines`` occurs.

    The pair of host and line is the key of the shuffle, so that a host of
    any size is spread, and counts are summed within tasks first.
    """
    return lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs"))


_WEIGHED = "row_key bigint, doc_id bigint, source string, residual bigint, template bigint, filler bigint, error bigint, script bigint, lines array<string>, sizes array<bigint>"


def _weigh_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split()[0] for f in _WEIGHED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.string()), pa.list_(pa.int64())]
    for batch in batches:
        out = []
        texts = batch.column("text").to_pylist()
        again = np.array([repeats(t) for t in texts], bool)
        near = _look(texts) | again
        for i in np.flatnonzero(near):
            residual, weight, content = 0, Counter(), Counter()
            for at, sentence, kind in kinds_of(texts[i], bool(again[i])):
                if kind != SKIP:
                    residual += len(sentence)
                    if kind == CONTENT:
                        content[at] += len(sentence)
                    else:
                        weight[KINDS[kind]] += len(sentence)
            if weight:
                raw = texts[i].splitlines()
                lines = [(normal(raw[at]), n) for at, n in content.items() if at < len(raw)]
                source = batch.column("source")[int(i)].as_py()
                key, doc = (batch.column(c)[int(i)].as_py() for c in ("row_key", "doc_id"))
                out.append((key, doc, source and source.strip().lower(), residual, weight["template"], weight["filler"], weight["error"], weight["script"], [x for x, _ in lines], [n for _, n in lines]))
        columns = list(zip(*out)) if out else [[]] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)


_NAMES = ("template", "filler", "error", "script")


def residue(documents: DataFrame) -> DataFrame:
    """``(doc_id, kind, share)`` of the documents that are residue instead of content.

    ``kind`` is the heaviest evidence (``template``, ``filler``, ``error``
    or ``script``), ``share`` the part of the residual that is evidence;
    a document is returned if it is more than half. Null, empty and blank
    texts are no cases; a null ``source`` has no boilerplate; a null
    ``doc_id`` is kept as null; repeated rows are judged each; an empty table
    gives no rows. Only ``doc_id``, ``text`` and ``source`` are read. Whole
    texts are judged, however long.
    """
    ship(documents.sparkSession)
    documents = documents.select("doc_id", "text", "source").where("text IS NOT NULL")
    weighed = materialise(documents.select(F.expr(ROW_KEY), "doc_id", "source", "text").mapInArrow(_weigh_all, _WEIGHED), "weighed")
    evidence = sum((F.col(k) for k in _NAMES[1:]), F.col(_NAMES[0]))
    heaviest = F.array_max(F.array(*(F.struct(F.col(k).alias("n"), F.lit(k).alias("k")) for k in _NAMES))).getField("k")
    weighed = weighed.select("row_key", "doc_id", "source", "residual", evidence.alias("evidence"), heaviest.alias("kind"), F.arrays_zip("lines", "sizes").alias("content"))
    # lines of documents with evidence, and how often these occur by host and in all
    lines = weighed.select("row_key", "source", "kind", (F.col("evidence") * 2 > F.col("residual")).alias("found"), F.explode("content").alias("c"))
    lines = materialise(lines.select("row_key", "source", "kind", "found", F.xxhash64("c.lines").alias("line"), F.col("c.sizes").alias("size")), "lines")
    open_lines = small(materialise(lines.select("line").distinct(), "open-lines"), LINE_BYTES)
    every_line = materialise(lines_of(documents), "every-line")
    counts = materialise(line_counts(every_line.join(open_lines, "line", "left_semi")), "line-counts")
    sizes = documents.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("host_docs"))
    recurrent = counts.where(F.col("source").isNotNull() & (F.col("docs") >= RECURS_DOCS)).join(small(sizes, LINE_BYTES), "source").where(F.col("docs") >= RECURS_SHARE * F.col("host_docs")).select("source", "line")
    # lines that recur almost only in residue are evidence, not boilerplate
    by_line = lines.where("found").groupBy("line").agg(F.countDistinct("row_key").alias("bad"), F.max("kind").alias("as"))
    everywhere = counts.groupBy("line").agg(F.sum("docs").alias("docs"))
    learnt = by_line.join(everywhere, "line").where((F.col("docs") >= RECURS_DOCS) & (F.col("bad") >= LEARNT_SHARE * F.col("docs"))).select("line", "as")
    learnt = small(materialise(learnt, "learnt"), LINE_BYTES)
    marked = lines.join(learnt, "line", "left").join(small(recurrent.withColumn("boiler", F.lit(1)), LINE_BYTES), ["source", "line"], "left")
    # rows of one key are copies and share their lines, counted once for each copy
    copies = weighed.groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"))
    moved = marked.groupBy("row_key").agg(F.sum(F.when(F.col("as").isNotNull(), F.col("size"))).alias("more"), F.sum(F.when(F.col("as").isNull() & F.col("boiler").isNotNull(), F.col("size"))).alias("less"))
    moved = moved.join(copies, "row_key").select("row_key", *((F.coalesce(c, F.lit(0)) / F.col("copies")).alias(c) for c in ("more", "less")))
    judged = weighed.drop("content").join(moved, "row_key", "left").fillna(0, ["more", "less"])
    total = F.col("evidence") + F.col("more")
    judged = judged.select("doc_id", "kind", total.alias("total"), F.greatest(F.col("residual") - F.col("less"), total).alias("left"))
    # documents without evidence of their own that consist of learnt lines
    held = every_line.join(learnt, "line", "left_semi").select("row_key").distinct().join(weighed.select("row_key"), "row_key", "left_anti")
    held = small(materialise(held, "held"), LINE_BYTES)
    whole = every_line.join(held, "row_key", "left_semi").dropDuplicates(["row_key", "line"]).join(learnt, "line", "left")
    whole = whole.groupBy("row_key").agg(F.max("as").alias("kind"), F.coalesce(F.sum(F.when(F.col("as").isNotNull(), F.col("size"))), F.lit(0)).cast("double").alias("total"), F.sum("size").cast("double").alias("left"))
    whole = documents.select(F.expr(ROW_KEY), "doc_id").join(small(whole, LINE_BYTES), "row_key").select("doc_id", "kind", "total", "left")
    return judged.unionByName(whole).where(F.col("total") * 2 > F.col("left")).select("doc_id", "kind", (F.col("total") / F.col("left")).alias("share"))
