"""Sentence units of documents in any of the languages and scripts, with their places.

A text is first cut into blocks: fenced code and heading lines are units of their own, list items
and paragraphs (ended by blank lines) are split further. Marks that always end a sentence in their
script do so; the period, which does not, is judged by the word before it. First by the document:
a word that stands with a period before small letters elsewhere, and never without, is an
abbreviation, a capitalised one that only names follow a title; words capitalised in mid-sentence
and never small are names. Where the document is silent, known abbreviations are grouped by what
may follow them, and what is left open is taken from counts over the corpus: words that are mostly
followed by something that begins no sentence, and small words (tool names) that begin paragraphs.
Quotations and brackets are kept whole; text in Thai is cut at spaces between Thai letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import checkpointed

# Abbreviations by what may follow them.
#: A name or noun follows; a sentence never ends here.
TITLES = frozenset("ee mr mrs ms dr dra prof profa st ste sr sra srta hr fr frau ing sig sigg dott avv eng exmo mme mlle mgr gen col capt lt sgt rev hon pres gov κ κα кг гр тов проф акад д-р डॉ प्रो श्री सुश्री د أ م".split())
#: A number or an address follows; before a capital the sentence may have ended.
BEFORE_NUMBERS = frozenset(
    "p pp pg pag pág págs s nr no nos n nº núm num fig figs abb abs art arts sec sect sez seç kap cap ch chap vol vols ver vers ref réf refs ed eds ca circa ungef approx aprox env max min zirka tel ziff zif рис стр гл табл разд п с ст № σελ σ αρ εικ κεφ сс पृ सं क्र ص رقم mind höchst tab eq".split()
)
#: Something of the same sentence follows, whatever its first letter.
WITHIN = frozenset("i.e e.g cf cfr vs viz vgl bzw sog z.b d.h u.a p.ex p.es c.-à-d c.à.d б т.е напр см π.χ δηλ βλ incl inkl exkl resp zzgl abzgl évtl evtl ggf geb gest i.d.r al ie eg т.н т.к s.o s.u o.ä m.e м ex es".split())
#: They can end a sentence; before a capital they do.
CAN_END = frozenset("etc usw ecc u.s.w u.ä κ.λπ κλπ κ.ά κ.α т.п т.д др пр ltd co corp inc bros jr sen gmbh u.s u.k u.n a.m p.m a.d b.c jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc dic ene abr ago gen mag giu lug set ott dez okt янв фев авг сент окт нояб дек г гг руб тыс млн млрд ч мин сек μ.μ π.μ u.v.m uu bd st.p approx".split())
#: Those of them that names follow as well.
BEFORE_NAMES = frozenset("u.s u.k u.n co corp inc ltd bros gmbh".split())
#: Words before a German ordinal.
ORDINAL_AFTER = frozenset("am im vom zum zur beim der die das dem den des ein eine einem einen einer ab seit bis jeder jede jedes jedem".split())

_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t ]+\S")
_ITEM = re.compile(r"[ \t ]*(?:[-*+•‣◦▪·–][ \t ]+|(\d{1,4})[.)][ \t ]+)(?=\S)")
_SPACE = re.compile(r"\s+")
_CLOSERS = ")]}»”’\"'」』）】›〉》"
_CAND = re.compile(r"[.!?…;。！？｡．؟۔।॥;]+")
_OPENERS = re.compile(r"[\"“„«「『(（【《‹]")
_CLOSE = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‹": "›"}
_PAREN = re.compile(r"[()]")
_EMOJI = re.compile(r"[\s]*(?:[\U0001F000-\U0001FAFF☀-➿⭐⭕✅❌‼⁉](?:[️‍\U0001F3FB-\U0001F3FF]|(?<=‍)[\U0001F000-\U0001FAFF☀-➿])*)+")
_HAS_EMOJI = re.compile(r"[\U0001F000-\U0001FAFF☀-➿]")
_THAI = re.compile(r"(?<=[ก-๛])\s+(?=[ก-๛])")
_THAI_ANY = re.compile(r"[ก-๛]")
_PLAIN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+(?=[\s,;:!?'’]|\.(?:\s|$)|$)")
_WORD_BEFORE = re.compile(r"[^\s(\[{\"“„«'’:,;/–—-]*$")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_OPEN_MARKS = "([{\"“„«'‘¿¡「『（【-*_–—"
_ENDS = ".!?…。！？｡؟۔।॥;;"
_ALWAYS = frozenset("。！？｡．؟۔।॥;")

_SHORT = re.compile(r"(?<![^\s(\[\"“„«])([^\W\d_]{1,6}(?:\.[^\W\d_]{1,3})*)\.[  ]+(\S[^\s]*)")
_FENCED = re.compile(r"(?ms)^[ \t]*(`{3,}|~{3,}).*?(?:^[ \t]*\1[`~]*[ \t\r]*$|\Z)")
_FIRST = re.compile(r"(?:\A|\n[ \t\r]*\n)[ \t]*([^\W\d_]{2,12})(?= [^\s])")
# What a document says of its words: small ones, capitals after a small word, with a period, without one.
_SMALL = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
_MIDDLE = re.compile(r"(?<=[^\W\d_A-ZÀ-ÞΑ-ΩА-Я])[  ]([^\W\d_a-zß-ÿα-ωа-я][^\W\d_]+)(?!\w)")
_CAPITAL = re.compile(r"[\s(\[\"“„«]*([^\W\d_]+)")
_DOTTED = re.compile(r"(?<![^\s(\[\"“„«])([^\W\d_]{2,12})\.[  ]+(?=\S)")
_STANDS = re.compile(r"(?<!\w)[^\W\d_]+(?![\w.])")
_WITH_PERIOD = re.compile(r"([^\s(\[{\"“„«'’:,;/–—.-]++(?:\.[^\s(\[{\"“„«'’:,;/–—.-]++)*+)\.")
_WHOLE_TEXT = re.compile(r"(?s).*")
_BEFORE_WORD = " \t\r\n\x0b\x0c\xa0([{\"“„«'’:,;/–—-."
_BARE = re.compile(r"(?<!\w)[^\W\d_]{2,12}(?![\w.])")
#: From so many occurrences on a word is judged by the corpus; the lists stay short whatever its size.
CORPUS_LEAST, CORPUS_SHARE = 20, 0.6
STARTER_SHARE = 0.0005
#: And from this share of documents on, which bounds the list by the words of a text over the share.
ABBREVIATION_SHARE = 0.0001
#: Counters of a task are passed on when they hold so many words.
HELD_WORDS = 200_000
#: So many words with a period are looked up one by one in a text; the others of it in a count of all.
LOOKUPS = 200


def blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind): kind 0 is a unit, 1 a paragraph, above it the length of an item's marker + 1."""
    at, n = 0, len(text)
    begin, kind, number, fence, blank = -1, 1, -1, "", True
    while at <= n:
        end = text.find("\n", at)
        if end < 0:
            end = n
        line = text[at:end]
        if fence:
            mark = _FENCE.match(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                yield begin, end, 0
                begin, fence, blank = -1, "", True
            at = end + 1
            continue
        if not line or line.isspace():
            if begin >= 0:
                yield begin, at, kind
                begin = -1
            blank = True
            at = end + 1
            continue
        first = line.lstrip()[0]
        if first in "`~" and (mark := _FENCE.match(line)) and "`" not in line[mark.end() :]:
            if begin >= 0:
                yield begin, at, kind
            begin, fence, number = at, mark[1], -1
        elif first == "#" and _HEADING.match(line):
            if begin >= 0:
                yield begin, at, kind
            yield at, end, 0
            begin, blank, number = -1, True, -1
            at = end + 1
            continue
        elif (first in "-*+•‣◦▪·–" or first.isdigit()) and (mark := _ITEM.match(line)) and (not mark[1] or blank or int(mark[1]) in (1, number + 1)):
            if begin >= 0:
                yield begin, at, kind
            begin, kind = at, mark.end() + 1
            number = int(mark[1]) if mark[1] else number
        elif begin < 0:
            begin, kind = at, 1
            if not line[:1].isspace():
                number = -1
        blank = False
        at = end + 1
    if begin >= 0:
        yield begin, n, 0 if fence else kind


def _intervals(text: str, s: int, e: int) -> list[tuple[int, int, str]]:
    """Quotations and brackets of a block, outermost only: (open, close, mark). Unclosed ones are no interval."""
    out = []
    at = s
    closed: dict[int, int] | None = None
    gone: set[str] = set()  # marks that close nothing from here on
    while m := _OPENERS.search(text, at, e):
        p, mark = m.start(), m[0]
        q = -1
        if mark == "(":
            if closed is None:
                closed = _paren_pairs(text, p, e)
            q = closed.get(p, -1)
        elif mark == '"':
            before = text[p - 1] if p > s else " "
            after = text[p + 1] if p + 1 < e else " "
            if not after.isspace() and not (before.isalnum() and before.isascii()):
                q = text.find('"', p + 1, e)
        else:
            ends = []
            for c in _CLOSE[mark]:
                if c not in gone:
                    if (i := text.find(c, p + 1, e)) >= 0:
                        ends.append(i)
                    else:
                        gone.add(c)
            q = min(ends, default=-1)
        if q < 0:
            at = p + 1
        else:
            out.append((p, q, mark))
            at = q + 1
    return out


def _paren_pairs(text: str, s: int, e: int) -> dict[int, int]:
    """Where each round bracket that is closed closes; one pass."""
    pairs, stack = {}, []
    for b in _PAREN.finditer(text, s, e):
        if b[0] == "(":
            stack.append(b.start())
        elif stack:
            pairs[stack.pop()] = b.start()
    return pairs


class Splitter:
    """Splits texts with what the corpus says about abbreviations and small first words."""

    def __init__(self, abbreviations: frozenset[str] = frozenset(), starters: frozenset[str] = frozenset()):
        self.abbreviations, self.starters = abbreviations, starters
        self._seen: tuple[str | None, set[str], set[str]] = None, set(), set()
        self._small: tuple[str | None, dict] = None, {}

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """[start, end) of every unit in code points, without white space at the ends; null and blank: none."""
        if not text:
            return []
        out: list[tuple[int, int]] = []
        for s, e, kind in blocks(text):
            if kind == 0:
                cuts = []
            else:
                cuts = self._cuts(text, s, e, s + kind - 1)
            at = s
            for c in [*cuts, e]:
                piece = text[at:c]
                a = at + len(piece) - len(piece.lstrip())
                b = at + len(piece.rstrip())
                if b > a:
                    out.append((a, b))
                at = c
        return out

    def _follows(self, text: str, i: int, e: int) -> str:
        """What stands at i: U capital, l small word, s small word that begins sentences, c code, d digit, o other script, p punctuation, '' nothing."""
        while i < e and (text[i].isspace() or text[i] in _OPEN_MARKS):
            if text[i] in "–—-" and i + 1 < e and text[i + 1].isspace():
                return "p"
            i += 1
        if i >= e:
            return ""
        c = text[i]
        if c.isupper() or c.istitle():
            return "U"
        if c.isdigit():
            return "d"
        if c.isalpha():
            if not c.islower():
                return "o"
            m = _PLAIN.match(text, i, e)
            if m is None:
                return "c"
            if m[0] in self.starters:
                return "s"
            return "l" if m[0].islower() else "c"
        return "c" if c in ".`@$/&~" else "p" if c in ",;:)]}»”’%=+|<>" else "o"

    def _word(self, text: str, s: int, i: int) -> tuple[str, int]:
        """The word that the period at i follows, inner periods kept, and where it begins."""
        lo = max(s, i - 40)
        m = _WORD_BEFORE.search(text, lo, i)
        w = m[0] if m else ""
        return w, i - len(w)

    def _period(self, text: str, s: int, e: int, i: int, j: int) -> bool:
        """Does the period at i, with the next text at j, end a sentence?"""
        kind = self._follows(text, j, e)
        if kind == "":
            return True
        if kind == "p":
            return False
        w, at = self._word(text, s, i)
        if not w:
            return True
        if not w.isascii():
            w = unicodedata.normalize("NFC", w)
        low = w.lower()
        if low.isdigit():
            if kind == "U" and len(low) <= 2:
                before = text[max(s, at - 12) : at].split()
                return not (before and before[-1].lower() in ORDINAL_AFTER)
            return True
        if len(low) > 1 and low != low.upper() and kind in "Ul" and low not in CAN_END and self._again(text, low) and low in self._document(text)[0]:
            # the document decides: an abbreviation by its other places; a name after it goes on, as does a small word
            m = _CAPITAL.match(text, j, e)
            if kind == "l" or m and m[1] in self._document(text)[1]:
                return False
            if low not in WITHIN and low not in TITLES:
                return True
        if len(w) <= 8:
            two = low
            if len(w) == 1 and at - s >= 3 and text[at - 1].isspace() and text[at - 2] == ".":
                two = text[at - 3].lower() + "." + low
            if len(w) == 1 and w.isalpha():
                number = at - 2 >= s and text[at - 1] in "  " and (text[at - 2].isdigit())
                if number and low != "г":
                    return True
                if number:
                    return kind in "Ucsdo"
                if low == "г":
                    return False
            for form in (two, low):
                if form in WITHIN:
                    return False
                if form in CAN_END:
                    return self._may_end(text, j, e, form, kind)
                if form in TITLES:
                    return False
                if form in BEFORE_NUMBERS:
                    return kind == "U" and (len(low) > 1 or low == "n") and low not in ("fig", "ref", "réf")
            if len(w) == 1 and w.isalpha() and not (two in self.abbreviations or low in self.abbreviations):
                return kind not in "Ul" if w.isupper() else kind in "Ucsdo" and not (kind == "U" and two != low)
        # lists and document are silent: the corpus
        if len(w) <= 8:
            # a word also stands without a period somewhere
            stands = kind == "l" and len(w) > 1 and w.isalpha() and w in self._of(text, _STANDS, frozenset)
            if not stands and (two in self.abbreviations or low in self.abbreviations):
                return kind in "U"
            if kind == "l" and len(w) <= 5 and w.isalpha():
                return stands
        return True

    def _again(self, text: str, low: str) -> bool:
        """Does the word stand with a period elsewhere too? Only then can the document tell more of it."""
        # words are looked up one by one while they are few; beyond that all are counted in one pass
        asked = self._of(text, None, dict)
        if low in asked:
            return asked[low]
        if len(asked) > LOOKUPS:
            return self._of(text, _WITH_PERIOD, lambda found: Counter(w.lower() for w in found))[low] > 1
        small = self._of(text, _WHOLE_TEXT, lambda found: found[0].lower())
        mark, n, at = low + ".", 0, -1
        while n < 2 and (at := small.find(mark, at + 1)) >= 0:
            n += at == 0 or small[at - 1] in _BEFORE_WORD
        asked[low] = n > 1
        return asked[low]

    def _of(self, text: str, pattern: re.Pattern | None, kept):
        """What a document holds of a pattern, found in one pass when first asked for."""
        if self._small[0] is not text:
            self._small = text, {}
        held = self._small[1]
        if pattern not in held:
            held[pattern] = kept(pattern.findall(text) if pattern else ())
        return held[pattern]

    def _document(self, text: str) -> tuple[set[str], set[str]]:
        """(abbreviations, names) by the unambiguous places of a document.

        Names stand with a capital after a small word and never small. Abbreviations never stand
        without their period, which comes before a small word (twice if they are long), or twice
        and always before a name (short capitalised ones: titles).
        """
        if self._seen[0] is not text:
            small = {w for w in _SMALL.findall(text) if w.islower()}
            names = {w for w in _MIDDLE.findall(text) if w.lower() not in small}
            before: dict[str, list[str]] = {}
            for m in _DOTTED.finditer(text):
                if m[1].upper() == m[1].lower():
                    continue  # a script without capitals: small letters after it tell nothing
                before.setdefault(m[1], []).append("l" if self._follows(text, m.end(), len(text)) == "l" else "n" if (x := _CAPITAL.match(text, m.end())) and x[1] in names else "")
            bare = {w.lower() for w in _BARE.findall(text)} if before else set()
            known = set()
            for w, kinds in before.items():
                low = kinds.count("l")
                title = w[0].isupper() and len(w) <= 5 and len(kinds) > 1 and kinds.count("n") == len(kinds)
                if w.lower() not in bare and (low > (len(w) > 5) or title):
                    known.add(w.lower())
            self._seen = text, known, names
        return self._seen[1:]

    def _may_end(self, text: str, j: int, e: int, form: str, kind: str) -> bool:
        if kind == "U":
            if form in BEFORE_NAMES:
                m = re.compile(r"\s*([^\W\d_]+)").match(text, j, e)
                # a name (never small in this document) continues, a common word begins a sentence
                return not m or m[1].lower() in self._of(text, _SMALL, frozenset)
            return True
        if form in ("a.m", "p.m", "etc", "usw", "ecc", "κ.λπ", "т.п", "т.д", "др"):
            return kind in "sco" and not (kind == "o" and form in ("etc", "usw", "ecc"))
        return kind in "s"

    def _cuts(self, text: str, s: int, e: int, scan: int) -> list[int]:
        """Where sentences of a block end."""
        cuts: list[int] = []
        spans = _intervals(text, scan, e)
        k, start = 0, scan
        thai = [m.start() for m in _THAI.finditer(text, scan, e)] if _THAI_ANY.search(text, scan, e) else []
        events: list[tuple[int, int, int]] = [(m.start(), m.end(), -1) for m in _CAND.finditer(text, scan, e)]
        if spans:
            events += [(q, q + 1, n) for n, (_, q, _) in enumerate(spans)]
            events.sort()
        done = scan
        for i, j, span in events:
            if i < done:
                continue
            if span < 0:
                while k < len(spans) and spans[k][1] < i:
                    k += 1
                if k < len(spans) and spans[k][0] < i:
                    continue
                end = self._mark(text, start, e, i, j)
            else:
                end = self._closed(text, start, e, spans[span])
            if end is None:
                continue
            end = self._absorb(text, end, e)
            cuts.append(end)
            done = end
            start = end
            while start < e and text[start].isspace():
                start += 1
        if thai:
            inside = [t for t in thai if not any(p < t < q for p, q, _ in spans)]
            cuts = sorted({*cuts, *inside})
        return cuts

    def _mark(self, text: str, s: int, e: int, i: int, j: int) -> int | None:
        """Where the sentence with the end mark at [i, j) ends, or None."""
        run = text[i:j]
        if len(run) > 1 and run[-1] == "." and run[-2] in "!?。！？।؟" and j < e and text[j].isalpha():
            # the period begins the next word: a hidden file
            j -= 1
            run = run[:-1]
        c = run[-1]
        after = text[j] if j < e else ""
        if run[0] in _ALWAYS:
            if c == "؟" or c in "।॥۔" or c in "。！？｡．;":
                return None if after and after in ",،、，)）" else j
        if ";" in run:
            if run != ";" or (after and not after.isspace()) and not (after.isupper()):
                return None
            return j if self._greek(text, s, i) else None
        if run[0] == "…" or run.startswith("..") or (c == "…"):
            if c in "!?":
                pass
            else:
                if after and not after.isspace() and after not in _CLOSERS:
                    return j if after.isupper() else None
                kind = self._follows(text, j, e)
                return j if kind in ("", "U", "s") else None
        if not after:
            return j
        if after.isspace():
            if c in "!?":
                return None if self._follows(text, j, e) == "p" else j
            if i > s and text[i - 1].isspace():
                return None
            return j if self._period(text, s, e, i, j) else None
        if after in _CLOSERS:
            x = j
            while x < e and text[x] in _CLOSERS:
                x += 1
            if x < e and not text[x].isspace():
                return None
            if c in "!?":
                return None if self._follows(text, x, e) in ("p", "l") else j
            return j if self._period(text, s, e, i, x) else None
        if c in "!?":
            if after.isalpha() or after in _OPEN_MARKS or _HAS_EMOJI.match(after):
                token = _SPACE.split(text[j : j + 40], maxsplit=1)[0]
                word = (text[max(s, i - 40) : i].rsplit(None, 1) or [""])[-1]
                if "=" in token or "&" in token or "://" in word:
                    return None
                return j
            return None
        # a period without a space after it
        if len(run) > 1 or i <= s or text[i - 1].isspace():
            return None
        if after.isupper():
            b = text[i - 1]
            m = _PLAIN.match(text, j, e)
            word = self._word(text, s, i)[0]
            if m is None and not re.compile(r"[^\W\d_]+(?:\.\.\.|[\w.]*\s)").match(text, j, e):
                return None
            if not (b.isalnum() or b in ")]%"):
                return None
            if len(word) <= 1 and word.isupper() or re.fullmatch(r"(?:[^\W\d_]\.)*[^\W\d_]", word) and len(word) <= 5 and not text[max(s, i - len(word) - 2) : i - len(word)].strip().isdigit():
                return None
            if word.lower() in TITLES or word.lower() in WITHIN:
                return None
            return j
        if after.isalpha() and not after.islower():
            word = self._word(text, s, i)[0]
            return None if word.lower() in TITLES or word.lower() in BEFORE_NUMBERS or len(word) < 1 else j
        if _HAS_EMOJI.match(after):
            return j
        return None

    def _greek(self, text: str, s: int, i: int) -> bool:
        return len(_GREEK.findall(text, max(s, i - 120), i)) > 3

    def _closed(self, text: str, start: int, e: int, span: tuple[int, int, str]) -> int | None:
        """Where the sentence ends if the quotation or bracket that closes here ends it, or None."""
        p, q, mark = span
        x = q - 1
        while x > p and (text[x].isspace() or text[x] in _CLOSERS):
            x -= 1
        if text[x] not in _ENDS or text[x] == ";":
            return None
        kind = self._follows(text, q + 1, e)
        if kind in ("", "p"):
            return q + 1 if kind == "" else None
        if mark in "(（【":
            return q + 1 if p <= start and kind != "l" else None
        y = p - 1
        while y >= start and text[y].isspace():
            y -= 1
        led = y >= start and text[y] in ":：,，"
        glued = q + 1 < e and not text[q + 1].isspace()
        if led:
            return q + 1 if kind != "l" or not glued and text[x] == "." else None
        if kind == "U":
            return None if glued and text[q + 1].isalpha() and p <= start else q + 1
        if p <= start:
            return None
        return q + 1 if kind in "sc" and not glued else None

    def _absorb(self, text: str, end: int, e: int) -> int:
        while end < e and text[end] in _CLOSERS:
            if text[end] in "\"'" and end + 1 < e and not (text[end + 1].isspace() or text[end + 1] in _CLOSERS):
                break
            end += 1
        if m := _EMOJI.match(text, end, e):
            end = m.end()
        return end


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition: what follows short words with a period, and the small words that begin paragraphs."""
    within, total, first = Counter(), Counter(), Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if "```" in text or "~~~" in text:
                text = _FENCED.sub("\n\n", text)
            for w, nxt in _SHORT.findall(text):
                w = w.lower()
                total[w] += 1
                c = nxt[0]
                if c.isdigit() or c.islower() and _PLAIN.match(nxt):
                    within[w, nxt.rstrip(".,;:") if c.islower() else "0"] += 1
            for w in _FIRST.findall(text):
                if w.islower():
                    first[w] += 1
        if len(total) + len(within) + len(first) > HELD_WORDS:
            yield _evidence_rows(total, within, first)
            within, total, first = Counter(), Counter(), Counter()
    yield _evidence_rows(total, within, first)


def _evidence_rows(total: Counter, within: Counter, first: Counter) -> pa.RecordBatch:
    # nothing is dropped here: what a task sees of a word says nothing about the corpus
    rows = [("t", w, "", n) for w, n in total.items()] + [("w", w, x, n) for (w, x), n in within.items()] + [("f", w, "", n) for w, n in first.items()]
    kinds, words, nexts, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(nexts, pa.string()), pa.array(counts, pa.int64())], ["kind", "word", "next", "n"])


def corpus_evidence(docs: DataFrame, text_col: str) -> tuple[frozenset[str], frozenset[str]]:
    """(abbreviations, small first words) over the whole corpus.

    Counts are combined in each task, then summed over the corpus; only sums are held against the
    bounds, so the number of tasks changes nothing. Only words above a fixed share of the documents
    (first words) or met with a period at least ``CORPUS_LEAST`` times, once in every ten thousand
    texts, and mostly inside sentences, whatever follows them, come back. Both bounds grow with the
    corpus, so the lists don't: they hold at most a text's mean number of such words over the share.
    """
    texts = docs.where(F.length(text_col) > 0).select(text_col)
    found = texts.mapInArrow(_evidence, "kind string, word string, next string, n bigint")
    counts = checkpointed(found.groupBy("kind", "word", "next").agg(F.sum("n").alias("n")))
    n_texts = texts.count()
    least = max(3.0, STARTER_SHARE * n_texts)
    first = counts.where((F.col("kind") == "f") & (F.col("n") >= least)).select(F.col("word").alias("next"))
    met = counts.where("kind <> 'f'").join(first, "next", "left_anti")
    sums = met.groupBy("word").agg(F.sum(F.expr("if(kind = 't', n, 0)")).alias("total"), F.sum(F.expr("if(kind = 'w', n, 0)")).alias("inside"))
    mostly = sums.where((F.col("total") >= max(CORPUS_LEAST, ABBREVIATION_SHARE * n_texts)) & (F.col("inside") >= CORPUS_SHARE * F.col("total")))
    return frozenset(r["word"] for r in mostly.select("word").collect()), frozenset(r["next"] for r in first.collect())


def _split(splitter: Splitter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            known: dict[str, list[tuple[int, int]]] = {}
            sizes, flat = [], []
            for text in batch.column(1).to_pylist():
                if text not in known:
                    known[text] = splitter.units(text)
                sizes.append(len(known[text]))
                flat.extend(known[text])
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            places = np.array(flat, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids, pa.array(places[:, 0]), pa.array(places[:, 1])], ["_id", "sent_start", "sent_end"])

    return run


def split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_start, sent_end): a row per unit, places in code points, end exclusive.

    Null, empty and blank texts have no unit. The language column is not consulted: script and
    words decide. A repeated id has its units once per row. Two passes: counts over the whole
    corpus, then every text on its own without a shuffle.
    """
    splitter = Splitter(*corpus_evidence(docs, text_col))
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long"), text_col)
    return rows.mapInArrow(_split(splitter), "_id bigint, sent_start int, sent_end int").toDF(id_col, "sent_start", "sent_end")
