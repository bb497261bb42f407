"""Text garbled by a wrong character encoding, found and restored by minimum description length.

For each language a zstandard dictionary is trained on a bounded sample of its documents. Each passage with characters
beyond ASCII is re-encoded by each encoding it may have been read with and decoded by each it may have been written in; the chain of
such steps that, compressed with a language's dictionary, takes the fewest bytes together with the cost of its steps is
taken, and the passage is left unchanged if that is the empty chain. Passages are the whole text, else its lines,
else their sentences: a sentence that shows garbled words beside sound ones decodes as a whole in no chain.
"""

from __future__ import annotations

import codecs
import gc
import html
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from operator import and_, or_

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import spread

#: Letters beyond ASCII of languages, small ones; capitals follow.
LETTERS = {
    "en": "éèêëïöçñüâàæœ",
    "de": "äöüß",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "es": "áéíóúüñ",
    "pt": "áâãàçéêíóôõúü",
    "pl": "ąćęłńóśźż",
    "cs": "áčďéěíňóřšťúůýž",
    "tr": "çğıöşüâîûi̇",
    "vi": "àáâãèéêìíòóôõùúýăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    "el": "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ",
}
SCRIPTS = {"ja": "\u3040-\u30ff\u4e00-\u9fff々〆ー", "zh": "\u4e00-\u9fff"}
CJK_MARKS = "\u3000-\u303f\uff01-\uff60\uffe5"
#: Signs that any text may use.
MARKS = "«»‹›„“”‘’‚–—…·•©®™°€£¥§№×÷±¡¿ªº½¼¾²³\u00a0\u00ad\u0300-\u036f\u2022\u2026"
#: Encodings a text may have been read with by mistake, and encodings it may have been written in, with their languages.
READ = "cp1252 latin-1 cp1250 iso8859-2 cp1251 koi8-r cp866 cp850 cp437 mac_roman cp1253 iso8859-7 cp1254 iso8859-9".split()
READ_WIDE = "gb18030 cp932 euc_jp".split()
WRITTEN = {
    "cp1252": "en de fr es pt", "cp850": "en de fr es pt", "cp437": "en de fr es", "mac_roman": "en de fr es pt", "cp1250": "pl cs de", "iso8859-2": "pl cs de", "cp852": "pl cs de",
    "cp1251": "ru", "koi8-r": "ru", "cp866": "ru", "mac_cyrillic": "ru", "cp1253": "el", "iso8859-7": "el", "cp1254": "tr", "iso8859-9": "tr",
}
WRITTEN_WIDE = {"gb18030": "zh", "cp932": "ja", "euc_jp": "ja"}
LANGUAGES = {w: tuple(x.split()) for w, x in (WRITTEN | WRITTEN_WIDE).items()}
#: Bytes that a step of a chain costs: UTF-8 that is read wrongly gives itself away, other bytes fit many encodings, and
#: more where the text shows no sign of them; and
#: bytes that each oddity of a text costs beyond its compressed size (signs inside words, letters of two scripts or
#: capitals after small letters side by side, control characters, drawing signs).
#: a loss of bytes costs a step.
UTF8_COST, OTHER_COST, HIDDEN_COST, ODD_COST, LOST_COST = 1, 6, 12, 2, 8
#: Passages of at most so many characters are remembered by a task, and how many of them.
SHORT, REMEMBERED = 400, 50_000
#: Bytes that other readings of a text's characters beyond ASCII may save with one dictionary: some at any rate, and some for each. No
#: bound of the format: of one character at most 15, of two at most 19 were seen (tests).
BASE_REACH, REACH = 20, 10
HEAD = 80
#: Bytes of the shortest zstandard frame of a text: magic number, header, header of the block and what it holds.
FRAME = 10
SENTENCE = re.compile(r"[。！？]+|[^\n。！？]*?[.!?]+[\"'»”)\]]*(?=\s|$)\s*|[^\n。！？]+")
#: Patterns that begin with one class of characters are searched for at the speed of that class, alternatives are not.
UTF8 = re.compile(rb"[\xc2-\xf4](?:(?<=[\xc2-\xdf])[\x80-\xbf]|(?<=[\xe0-\xef])[\x80-\xbf]{2}|(?<=[\xf0-\xf4])[\x80-\xbf]{3})")
ASCII = bytes(range(128))
HIGH_RUNS, LONG_RUN = re.compile("[^\x00-\x7f][^\x00-\x7f]+"), re.compile("[^\x00-\x7f](?:[^\x00-\x7f]|[0-9][^\x00-\x7f][0-9])")
FOLLOWED = re.compile("[^\x00-\x7f][^\x00-\x7f]*[\x00-\x7f]?")
#: A run, the character before it and the one after it.
NEAR = re.compile("([^\x00-\x7f](?:(?<=([\x00-\x7f])[^\x00-\x7f]))?[^\x00-\x7f]*)(?=([\x00-\x7f]?))")
ENDS = re.compile(rb"[\n.!?]")
C1 = re.compile("[\x80-\x9f]")
ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}\d{0,2}|#\d{2,5}|#[xX][0-9A-Fa-f]{2,4});")
LETTER = r"[^\W\d_]"
CAPITALS = "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isupper())
SIGNS = "±¶¤¦§¨¬°¹²³¼½¾µ¿¡©®´¸˝ˇ˘˙˛¯¢£¥€‡†‰‹›™•ªº÷×√∂≈≤≥∞∫Ω◊\u2500-\u25ff"
SHAPES = re.compile(rf"{LETTER}[{SIGNS}]+{LETTER}|[a-zß-ÿ][{CAPITALS}]|[а-яё][А-ЯЁ]|[A-Za-zÀ-ɏ][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-zÀ-ɏ]")
SHAPED = re.compile(f"[{SIGNS}{CAPITALS}\u0370-\u04ff]")
#: The first two of SHAPES from the sign or capital on, and the others, which need Greek or Cyrillic letters.
SHAPES_LATIN = re.compile(rf"[{SIGNS}{CAPITALS}](?:(?<={LETTER}[{SIGNS}])[{SIGNS}]*{LETTER}|(?<=[a-zß-ÿ][{CAPITALS}]))")
SHAPES_OTHER = re.compile("[а-яё][А-ЯЁ]|[A-Za-zÀ-ɏ][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-zÀ-ɏ]")
#: Marks that a letter's byte may become, between letters; sound texts have them there now and then.
JOINTS = "„“”‚…£¡¿"
JOINT = re.compile(f"[{JOINTS}]")
JOINED = re.compile(rf"(?<={LETTER})[{JOINTS}]+(?={LETTER})")
SANDWICH = re.compile("[\u3040-\u30ff\u4e00-\u9fff](?<=[a-zß-ÿ].)(?=[a-zß-ÿ])")
ODD = re.compile("[\x80-\x9f\u2200-\u22ff\u2320-\u23ff\u2500-\u25ff\uff61-\uff9f˝ˇ˘˙˛¸¯¨´◊√Ω]")
#: Runs of replacement characters, and such that aren't a single sign between blanks.
LOST, TORN = re.compile("\ufffd+"), re.compile(rf"(?<={LETTER})\ufffd+|\ufffd+(?={LETTER})|\ufffd{{2,}}")
#: A character beside letters of ASCII: it, the one before and the one after.
BESIDE = re.compile("([^\x00-\x7f])(?:(?<=([A-Za-z])[^\x00-\x7f])|(?=[A-Za-z]))(?=([A-Za-z]?))")
#: Characters of East Asian encodings: what a wrong reading in one of these gives begins with one of them.
WIDE_SIGN = re.compile("[\u1100-\u11ff\u2e80-\u9fff\ua000-\ud7ff\ue000-\ufaff\uff00-\uffef]")


def language(name: str | None) -> str | None:
    """Two letters of a language tag in any notation, if it is one of those known here."""
    code = (name or "").strip().lower()[:2]
    return code if code in LETTERS or code in SCRIPTS else None


@lru_cache(None)
def table(read: str) -> dict[str, int]:
    """Character -> byte beyond ASCII of a single-byte encoding; its undefined bytes are control characters."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(read)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    return out


@lru_cache(None)
def foreign(lang: str) -> re.Pattern:
    """Characters that a wrong reading may give and that texts of a language hardly use."""
    own = SCRIPTS[lang] + CJK_MARKS if lang in SCRIPTS else LETTERS[lang] + LETTERS[lang].upper()
    mine = re.compile(f"[{MARKS}{own}]")
    given = {c for r in READ for c in table(r)}
    single = "".join(sorted(re.escape(c) for c in given if not mine.match(c)))
    wide = "" if lang in SCRIPTS else "\u4e00-\u9fff\u3040-\u30ff"
    return re.compile(f"[{single}{wide}\uff61-\uff9f\ue000-\uf8ff]")


@lru_cache(None)
def unlike(written: str) -> tuple[bool, ...]:
    """Of each byte from 128 on whether, in this encoding, it is foreign to all languages written in it."""
    langs = WRITTEN[written].split()
    return tuple(c is None or all(foreign(x).match(c) for x in langs) for c in letters_of(written))


@lru_cache(None)
def letters_of(written: str) -> tuple[str | None, ...]:
    """The character of each byte from 128 on; None where it has none."""
    return tuple(bytes([b]).decode(written, "ignore") or None for b in range(128, 256))


@lru_cache(None)
def swapped(read: str, written: str) -> tuple[dict[str, str], frozenset[str]]:
    """The characters of one reading of bytes as those of another, '' where it has none or an odd one; those that become foreign."""
    u, new = unlike(written), letters_of(written)
    other = {c: new[b - 128] or "" for c, b in table(read).items()}
    return {c: "" if ODD.match(x) else x for c, x in other.items()}, frozenset(c for c, b in table(read).items() if u[b - 128])


#: Every pair of single-byte encodings; bit i of the masks below is pair i.
PAIRS = [(read, written) for read in sorted(READ) for written in sorted(WRITTEN) if read != written]
SIGN, GREEK_CYRILLIC, CAPITAL = re.compile(f"[{SIGNS}]"), re.compile("[\u0370-\u04ff]"), re.compile(f"[{CAPITALS}]")
SMALL, LATIN, LOWER, UPPER = re.compile("[ß-ÿ]"), re.compile("[À-ɏ]"), re.compile("[а-яё]"), re.compile("[А-ЯЁ]")


@lru_cache(None)
def classes(x: str) -> tuple[str, ...]:
    """The fields of Turns whose class a character is of."""
    kinds = {"script": GREEK_CYRILLIC, "capital": CAPITAL, "sign": SIGN, "small": SMALL, "latin": LATIN, "lower": LOWER, "upper": UPPER}
    return tuple(k for k, p in kinds.items() if p.match(x))


@dataclass(frozen=True, slots=True)
class Turns:
    """What becomes of a character in each of PAIRS, as masks."""

    valid: int = 0  # it has another reading that isn't odd
    changed: int = 0
    alien: int = 0  # it becomes foreign
    script: int = 0  # a Greek or Cyrillic letter
    capital: int = 0
    sign: int = 0  # a sign that no word has inside
    small: int = 0  # a small Latin letter beyond ASCII
    latin: int = 0  # a Latin letter beyond ASCII
    lower: int = 0  # a small Russian letter
    upper: int = 0  # a capital Russian letter
    reads: int = 0  # bits over READ: encodings that have it
    lead: int = 0  # those of READ in which its byte may begin a character of UTF-8
    tail: int = 0  # those in which it may go on one
    to: tuple[str, ...] = ()  # the other reading
    all: int = 0  # valid and reads side by side, which hold for a text if they hold for each character
    any: int = 0  # changed, alien, lead and tail, for which one suffices


@lru_cache(None)
def turns(c: str) -> Turns:
    if not any(c in table(read) for read in READ):
        return Turns(to=("",) * len(PAIRS))
    out = dict.fromkeys(Turns.__slots__, 0)
    out["to"] = tuple(swapped(*pair)[0].get(c, "") for pair in PAIRS)
    for i, (read, written) in enumerate(PAIRS):
        other, alien = swapped(read, written)
        if x := other.get(c):
            for k in ("valid", *(("changed",) if x != c else ()), *(("alien",) if c in alien else ()), *classes(x)):
                out[k] |= 1 << i
    out["reads"] = sum(1 << i for i, read in enumerate(READ) if c in table(read))
    out["lead"] = sum(1 << i for i, read in enumerate(READ) if 0xC2 <= table(read).get(c, 0) <= 0xF4)
    out["tail"] = sum(1 << i for i, read in enumerate(READ) if 0x80 <= table(read).get(c, 0) <= 0xBF)
    out["all"] = out["valid"] | out["reads"] << len(PAIRS)
    out["any"] = out["changed"] | out["alien"] << len(PAIRS) | (out["lead"] | out["tail"] << len(READ)) << 2 * len(PAIRS)
    return Turns(**out)


class Masks(dict):
    """Masks by what they are of, looked up without a call where they are known; so many at most."""

    def __init__(self, of: Callable[[Hashable], int], most: int = 50_000):
        self.of, self.most = of, most

    def __missing__(self, key: Hashable) -> int:
        if len(self) >= self.most:
            self.clear()
        self[key] = mask = self.of(key)
        return mask


ALL, ANY = Masks(lambda c: turns(c).all), Masks(lambda c: turns(c).any)


def bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        mask ^= low
        yield low.bit_length() - 1


@dataclass(frozen=True, slots=True)
class Shared:
    """What holds for every text with the same characters beyond ASCII."""

    reads: tuple[int, ...]  # encodings that have all of them, by their place in READ
    wide_reads: int  # pairs of these encodings with WRITTEN_WIDE
    utf8: int  # bits over READ: those of them that give bytes which UTF-8 begins and goes on with
    swaps: int  # those of PAIRS that give each another reading, not odd, and at least one a different one
    alien: int  # those that make one foreign
    wide: bool


@lru_cache(20_000)
def shared(chars: str) -> Shared:
    each, some = reduce(and_, map(ALL.__getitem__, chars), -1), reduce(or_, map(ANY.__getitem__, chars), 0)
    pairs, ones = (1 << len(PAIRS)) - 1, (1 << len(READ)) - 1
    changed, alien, reads = some & pairs, some >> len(PAIRS) & pairs, each >> len(PAIRS)
    lead, tail = some >> 2 * len(PAIRS) & ones, some >> 2 * len(PAIRS) + len(READ)
    return Shared(*places(reads & ones), lead & tail, each & pairs & changed, alien, WIDE_SIGN.search(chars) is not None)


@lru_cache(None)
def places(reads: int) -> tuple[tuple[int, ...], int]:
    """The encodings of a mask over READ, and all pairs of these with WRITTEN_WIDE."""
    own, n = tuple(bits(reads)), len(WRITTEN_WIDE)
    return own, sum((1 << n) - 1 << i * n for i in own)


@lru_cache(20_000)
def opened(run: str) -> int:
    """Bits over READ: those in which two bytes side by side in a run may begin a character of UTF-8 and go on with it."""
    out = 0
    for a, b in zip(run, run[1:]):
        out |= turns(a).lead & turns(b).tail
    return out


def side_by_side(text: str) -> int:
    """opened() of all runs of a text: elsewhere a text read in a single-byte encoding holds no UTF-8."""
    return reduce(or_, map(opened, set(HIGH_RUNS.findall(text))), 0)


@lru_cache(20_000)
def distinct(chars: str, mask: int) -> list[tuple[int, str]]:
    """The first of each of the pairs of a mask that read characters alike, with that reading."""
    out: dict[str, int] = {}
    rows = [turns(c).to for c in chars]
    for i in bits(mask):
        out.setdefault("".join([r[i] for r in rows]), i)
    return [(i, x) for x, i in out.items()]


@lru_cache(20_000)
def strange(chars: str, lang: str) -> bool:
    """Whether characters are foreign, some to a language and some to English."""
    return all(foreign(x).search(chars) for x in {lang, "en"})


def aliens(high: str, chars: str, lang: str) -> int:
    """Number of the characters foreign to a language; chars: each of them once."""
    return sum(map(high.count, foreign(lang).findall(chars)))


def neighbours(text: str) -> str:
    """The runs beyond ASCII with the characters beside them, each once."""
    return "\n".join(sorted([before + run + after for run, before, after in set(NEAR.findall(text))]))


def unbroken(left: int, text: str, full: bool = True) -> int:
    """Those of some pairs that give none of SHAPES beside letters of ASCII, or of two characters in the first runs, as the masks tell; full: anywhere, not only in the first words."""
    head = text[:HEAD]  # mostly none is left after a few words
    left = reduce(and_, map(BESIDES.__getitem__, set(BESIDE.findall(head))), left)
    for run in HIGH_RUNS.findall(head) if left else ():
        left = reduce(and_, map(BETWEENS.__getitem__, zip(run, run[1:])), left)
    return reduce(and_, map(BESIDES.__getitem__, set(BESIDE.findall(text))), left) if left and full and len(text) > HEAD else left


def unbroken_beside(beside: tuple[str, str, str]) -> int:
    c, before, after = beside
    t = turns(c)
    return ~(t.script | (t.capital if before > "Z" else 0) | (t.sign if before and after else 0))


def unbroken_between(two: tuple[str, str]) -> int:
    t, u = map(turns, two)
    return ~(t.small & u.capital | t.lower & u.upper | t.latin & u.script | t.script & u.latin)


BESIDES, BETWEENS = Masks(unbroken_beside), Masks(unbroken_between)


def shapely(ranked: list[tuple[int, int, str]], around: str, mine: int) -> list[tuple[int, int]]:
    """(place in PAIRS, cost) of those of (foreign characters, place, reading of the characters) that give none of SHAPES; mine: foreign ones now."""
    if not ranked:
        return []
    signs, shaped = joints(around), misshapen(around)
    tried, out, raws = set(), [], {}
    for bad, i, mapped in ranked:
        if mapped in tried:  # other bytes, but the same text
            continue
        tried.add(mapped)
        read, written = PAIRS[i]
        if read not in raws:
            raws[read] = to_bytes(around, read)
        near = raws[read].decode(written)
        if not misshapen(near):
            fewer = signs - joints(near)
            cost = OTHER_COST if bad < mine or shaped or fewer > 0 else HIDDEN_COST
            out.append((i, cost - ODD_COST * fewer))
    return out


#: Characters beyond ASCII up to which they and their neighbours are remembered with their swaps.
FEW = 12


@lru_cache(50_000)
def exchanges(around: str, chars: str, left: int, strange: bool) -> list[tuple[int, int]]:
    """shapely() of the pairs of a mask that make no character foreign, for all texts with the same characters beyond ASCII and neighbours of these."""
    return shapely([(0, i, mapped) for i, mapped in distinct(chars, unbroken(left, around))], around, int(strange))


def decoded(raw: bytes, written: str, lossy: bool) -> str | None:
    """Bytes as written; lossy: up to one character in twenty may be missing."""
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        if not lossy or len(raw) < 20:
            return None
    if len(raw) > 2 * HEAD and (raw[:HEAD].decode(written, "replace").count("\ufffd") - 1) * 20 > len(raw):  # too many already; the last may be cut
        return None
    new = raw.decode(written, "replace")
    return new if new.count("\ufffd") * 20 <= len(new) else None


#: Runs that unreadable() looks at, and characters of the longest.
RUNS, RUN = 8, 40


@lru_cache(20_000)
def outcome(run: str, before: str = "", after: str = "") -> tuple[int, int]:
    """Pairs (READ, WRITTEN_WIDE) as which a run of characters and the one after it can't be read, and those that are amid a character then.

    Readings that set a character between the small letters before and after count as none, if these are given.
    """
    fails = amid = 0
    for i, read in enumerate(READ):
        raw = to_bytes(run, read)
        for j, written in enumerate(WRITTEN_WIDE if raw else ()):
            reader, bit = codecs.getincrementaldecoder(written)(), 1 << i * len(WRITTEN_WIDE) + j
            try:
                new = reader.decode(raw)
            except UnicodeDecodeError:
                fails |= bit
            else:
                if reader.getstate()[0]:
                    amid |= bit
                elif before and SANDWICH.search(before + new + after):
                    fails |= bit
    return fails, amid


def unreadable(text: str, known: int, sandwiches: bool = False) -> int:
    """Those of some pairs (READ, WRITTEN_WIDE) that can't be how a text was read and written, as its first runs beyond ASCII tell; others may fail later.

    sandwiches: readings that set a character between small letters count as none.
    """
    bad = end = 0
    for k, m in enumerate(FOLLOWED.finditer(text)):
        if k == RUNS or len(run := m[0]) > RUN:
            break
        # A letter that follows a run may be part of that run's last character.
        start, before = m.start(), ""
        if sandwiches and start > end and "a" <= text[start - 1] <= "z":
            before = "a"
        end = m.end()
        fails, amid = outcome(run, before, "a" if "a" <= text[end : end + 1] <= "z" else "") if before else outcome(run)
        bad |= fails & known
        known &= ~(fails | amid)  # where a character goes on beyond the run, the next run doesn't begin one
        if not known:
            break
    return bad


@lru_cache(None)
def plain_bytes(written: str) -> tuple[bytes, bytes]:
    """The bytes of a single-byte encoding that are characters and not odd, and those of them not foreign to all its languages."""
    good = [b for b in range(256) if b < 128 or (c := letters_of(written)[b - 128]) and not ODD.match(c)]
    return bytes(good), bytes(b for b in good if b < 128 or not unlike(written)[b - 128])


@lru_cache(None)
def unsound(own: bool) -> tuple[int, ...]:
    """Of each byte those of LANGUAGES, as bits, in which it is no character or an odd one, or (own) a foreign one; none of those with several bytes."""
    return tuple(sum(1 << i for i, written in enumerate(LANGUAGES) if written in WRITTEN and b not in plain_bytes(written)[own]) for b in range(256))


def characters(text: str) -> str:
    """A text with its references to characters beyond ASCII resolved; those to ASCII ones (`&lt;`) stay as they are."""

    def one(m: re.Match) -> str:
        c = html.unescape(m[0])
        return m[0] if c.isascii() else c

    return ENTITY.sub(one, text) if "&" in text else text


@lru_cache(256)
def oddities(text: str) -> int:
    """Number of the oddities of a text."""
    return 0 if text.isascii() else (len(SHAPES.findall(text)) if misshapen(text) else 0) + len(ODD.findall(text))


def misshapen(text: str) -> bool:
    """Whether a text has one of SHAPES; most have no character that may be part of one."""
    if not SHAPED.search(text):
        return False
    return SHAPES_LATIN.search(text) is not None or GREEK_CYRILLIC.search(text) is not None and SHAPES_OTHER.search(text) is not None


def joints(text: str) -> int:
    return len(JOINED.findall(text)) if JOINT.search(text) else 0


def without_ascii(text: str) -> str:
    """The characters beyond ASCII, in their order."""
    return text.encode("utf-8", "surrogatepass").translate(None, ASCII).decode("utf-8", "surrogatepass")


def beyond(text: str) -> int:
    """Number of characters beyond ASCII."""
    return len(text) - len(text.encode("ascii", "ignore"))


@lru_cache(None)
def as_read(read: str):
    """The codec's map of characters to the bytes read."""
    given = {b: c for c, b in table(read).items()}
    return codecs.charmap_build("".join(map(chr, range(128))) + "".join(given[b] for b in range(128, 256)))


def to_bytes(text: str, read: str) -> bytes | None:
    """The bytes that were read as text; None if that encoding can't have given it."""
    try:
        return text.encode(read) if read == "gbk" or read in READ_WIDE else codecs.charmap_encode(text, "strict", as_read(read))[0]
    except UnicodeEncodeError:
        return None


def whole(raw: bytes) -> bool:
    """Whether bytes beyond ASCII are UTF-8 sequences but for few."""
    sound = UTF8.findall(raw)
    return bool(sound) and (len(raw.translate(None, ASCII)) - len(b"".join(sound))) * 8 <= len(sound)


def from_utf8(raw: bytes) -> str | None:
    """UTF-8 text of bytes whose sequences are whole but for few, a non-breaking space that became a blank among them."""
    if not UTF8.search(raw):
        return None
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    sound = UTF8.findall(raw)
    n, left = len(sound), len(raw.translate(None, ASCII)) - len(b"".join(sound))
    if left * 32 > n * 21:  # a quarter of the sequences may be mended besides, of two bytes left each: (left - n / 2) * 8 <= n * 5 / 4
        return None
    mended, blanks = re.subn(rb"([\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]) ", b"\\1\xa0", raw)
    raw = mended if blanks * 4 <= n else raw
    return raw.decode("utf-8", "replace") if whole(raw) else None


@dataclass
class Restorer:
    """Finds and restores garbled passages with the dictionaries of languages."""

    dictionaries: dict[str, bytes]
    level: int = 3
    _coders: dict = field(default_factory=dict, repr=False)
    _met: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "level": self.level, "_coders": {}, "_met": {}}

    def coder(self, lang: str):
        """What compresses with the dictionary of lang."""
        if lang not in self._coders:
            d = self.dictionaries.get(lang)
            args = {"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}
            if d:
                args["dict_data"].precompute_compress(level=self.level)
            self._coders[lang] = zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False, **args).compress
        return self._coders[lang]

    def size(self, text: str, lang: str) -> int:
        """Bytes of text with the dictionary of lang."""
        return len(self.coder(lang)(text.encode("utf-8", "replace")))

    def length(self, text: str, lang: str) -> int:
        """Description length of text: its compressed size and the cost of its oddities."""
        return self.size(text, lang) + ODD_COST * oddities(text)

    def guess(self, text: str) -> str:
        """The language whose dictionary compresses text best."""
        return min(self.dictionaries or ["en"], key=lambda x: (self.size(text, x), x))

    def likelier(self, text: str, lang: str) -> str:
        """guess() if text has fewer characters foreign to that language than to lang; else lang."""
        high = without_ascii(text)
        chars = "".join(set(high))
        found = aliens(high, chars, lang)
        fewer = [x for x in self.dictionaries if x != lang and aliens(high, chars, x) < found] if found else []
        if not fewer or lang in self.dictionaries and min([*fewer, lang], key=lambda x: (self.size(text, x), x)) == lang:
            return lang  # it isn't one of these
        near = self.guess(text)
        return near if near in fewer else lang

    def suspicious(self, text: str, lang: str | None) -> bool:
        """Whether a text has characters foreign to its language or looks like bytes read wrongly, so that its language is in doubt."""
        if text.isascii():
            return False
        if "\ufffd" in text or C1.search(text) or misshapen(text) or lang is None or foreign(lang).search(text):
            return True
        may = side_by_side(text)
        for read in ("cp1252", "cp1251", "cp1250", "mac_roman", "cp850"):
            if not may >> READ.index(read) & 1:
                continue
            raw = text.encode(read, "replace")
            if UTF8.search(raw) and any(whole(part) for part in ENDS.split(raw)):
                return True
        return False

    def candidates(self, text: str, lang: str) -> list[tuple[str, int, tuple[str, ...], str]]:
        """(decoded, cost of step and oddities, languages, step) of the steps that may undo a wrong reading of text."""
        out, seen = [], {text}
        high = without_ascii(text)
        chars = "".join(sorted(set(high)))
        same = shared(chars)

        def add(new: str | None, cost: int, langs: tuple[str, ...], step: str, odd: int | None = None) -> None:
            if new and new not in seen:
                seen.add(new)
                out.append((new, cost + ODD_COST * (oddities(new) if odd is None else odd), langs, step))

        raws: dict[bytes, int] = {}
        # A character of several bytes is two beyond ASCII of a single-byte encoding or more, or such and digits in turn (gb18030).
        if same.reads and LONG_RUN.search(text):
            n, wide, all_wide = len(high), len(WRITTEN_WIDE), (1 << len(WRITTEN_WIDE)) - 1
            likely = n >= 4 and (lang in SCRIPTS or n * 3 > len(text))
            bad = 0 if likely else unreadable(text, same.wide_reads, True)  # some characters may be missing where it is likely
            utf8 = same.utf8 if not same.utf8 or n * 3 > len(text) else same.utf8 & side_by_side(text)
            for i in same.reads:
                if not utf8 >> i & 1 and bad >> i * wide & all_wide == all_wide:
                    continue
                raw = to_bytes(text, READ[i])
                if raw not in raws:
                    raws[raw] = i
                    if utf8 >> i & 1 and UTF8.search(raw):
                        add(from_utf8(raw), UTF8_COST, tuple(self.dictionaries), f"{READ[i]}>utf-8")
        if same.wide:
            told, mine = OTHER_COST if foreign(lang).search(chars) else HIDDEN_COST, aliens(high, chars, lang)
            for read in READ_WIDE:
                raw = to_bytes(text, read)
                add(raw and from_utf8(raw), UTF8_COST, tuple(self.dictionaries), f"{read}>utf-8")
                raw = to_bytes(text, "gbk") if read == "gb18030" else raw  # two bytes a character; four have digits among them
                if not raw:
                    continue
                # Some may become foreign: no more than there are in the text as it is, and a tenth.
                most = min(mine, len(raw.translate(None, ASCII)) // 10)
                ruled = reduce(or_, map(unsound(not most).__getitem__, set(raw)), 0)
                for i, written in enumerate(LANGUAGES):
                    if written != read and not ruled >> i & 1:
                        add(self.narrowed(raw, written, most), told, LANGUAGES[written], f"{read}>{written}")
        if same.swaps:
            for new, cost, written, step in self.swaps(text, lang, high, chars, same):
                add(new, cost, LANGUAGES[written], step, 0)
        for raw, i in raws.items():
            for j, written in enumerate(WRITTEN_WIDE):
                new = None if bad >> i * wide + j & 1 else decoded(raw, written, likely)
                if new and not SANDWICH.search(new):
                    add(new, OTHER_COST if likely else HIDDEN_COST, LANGUAGES[written], f"{READ[i]}>{written}")
        return out

    @staticmethod
    def narrowed(raw: bytes, written: str, most: int) -> str | None:
        """Bytes that were read in an East Asian encoding, as written in another; None if that leaves odd characters or more than most foreign ones."""
        if written in WRITTEN_WIDE:
            new = decoded(raw, written, True)
            return new if new and not SANDWICH.search(new) else None
        sound, own = plain_bytes(written)
        bad = len(raw.translate(None, own))
        if bad and (bad > most or raw.translate(None, sound)):
            return None
        new = raw.decode(written)
        return None if misshapen(new) else new

    @staticmethod
    def swaps(text: str, lang: str, high: str, chars: str, same: Shared) -> Iterator[tuple[str, int, str, str]]:
        """(decoded, cost, written, step) of the pairs of single-byte encodings that leave nothing odd and hardly anything foreign."""
        mine = min(aliens(high, chars, x) for x in {lang, "en"}) if strange(chars, lang) else 0
        # Some become foreign: no more than there are in the text as it is, and a tenth.
        most = min(mine, len(high) // 10) if mine and same.swaps & same.alien else 0
        left = same.swaps if most else same.swaps & ~same.alien
        if not left:
            return
        if most:
            many = {c: high.count(c) for c in chars}
            bad = {i: sum(n for c, n in many.items() if turns(c).alien >> i & 1) for i in bits(unbroken(left, text))}
            ranked = sorted((b, i) for i, b in bad.items() if b <= most)
            kept = shapely([(b, i, "".join(swapped(*PAIRS[i])[0][c] for c in chars)) for b, i in ranked], neighbours(text), mine) if ranked else []
        elif not (left := unbroken(left, text, len(high) > FEW)):
            kept = []
        elif len(high) <= FEW:
            kept = exchanges(neighbours(text), chars, left, mine > 0)
        else:
            kept = shapely([(0, i, mapped) for i, mapped in distinct(chars, left)], neighbours(text), mine)
        raws: dict[str, bytes] = {}
        for i, cost in kept:
            read, written = PAIRS[i]
            if read not in raws:
                raws[read] = to_bytes(text, read)
            yield raws[read].decode(written), cost, written, f"{read}>{written}"

    def chain(self, text: str, lang: str) -> tuple[str, list[str]]:
        """The decoding of least description length, step by step until none shortens, and its steps; none if text is best as it is."""
        steps: list[str] = []
        best, sure, known = -1, False, self.dictionaries
        while not text.isascii():  # each step is shorter than the one before
            found, options = None, self.candidates(text, lang)
            own: dict[str, int] = {}  # sizes of the text itself
            if options and best < 0:
                own = {x: self.size(text, x) for x in {lang, "en"}}
                best = min(own.values()) + ODD_COST * oddities(text)
            reach = BASE_REACH + REACH * beyond(text) if options else 0
            for new, cost, langs, step in options:
                if cost + FRAME >= best:  # whatever its compressed size
                    continue
                raw = None
                near = langs if len(langs) < 6 else [x for x in langs if x in (lang, "en") or not foreign(x).search(new)]
                for x in [x for x in near if x in known] or [lang]:
                    if reach < best:
                        if x not in own:
                            own[x] = self.size(text, x)
                        if own[x] - reach + cost >= best:
                            continue
                    raw = raw or new.encode("utf-8", "replace")
                    total = len(self.coder(x)(raw)) + cost
                    if total < best and not sure:  # the text itself gets the best of all languages, too
                        best, sure = min([best, *(self.length(text, y) for y in self.dictionaries)]), True
                    if total < best and (found is None or total < found[0]):
                        found = (total, new, step)
            if not found:
                break
            best, text = found[0], found[1]
            steps.append(found[2])
        return text, steps

    def restore(self, text: str | None, lang_tag: str | None) -> tuple[str | None, list[str]]:
        """The restored text and the steps used, '?' standing for passages whose bytes are lost; no steps if it is sound."""
        if not text:
            return text, []
        plain = characters(text)  # bytes read wrongly may have been written as character references since
        if plain.isascii():
            return text, []
        lang = language(lang_tag)
        if lang is None or self.suspicious(plain, lang):
            lang = self.guess(plain) if lang is None else self.likelier(plain, lang)
        new, steps = self.passage(text, lang)
        if not steps:
            new, steps = self.by_passage(text, lang)
        if self.lost(new, lang):
            steps = [*steps, "?"]
        return new, list(dict.fromkeys(steps))

    def passage(self, text: str, lang: str) -> tuple[str, list[str]]:
        """chain() of a passage with its character references resolved; as it is, references and all, if that finds nothing."""
        if text.isascii() and "&" not in text:
            return text, []
        known = self._met.get((text, lang))
        if known is None:
            plain = characters(text)
            new, steps = self.chain(plain, lang)
            known = (new, ["html", *steps] if plain != text else steps) if steps else (text, [])
            if len(text) <= SHORT:  # menus, notices and footers come again and again
                if len(self._met) >= REMEMBERED:
                    self._met.clear()
                self._met[text, lang] = known
        return known

    def by_passage(self, text: str, lang: str) -> tuple[str, list[str]]:
        """Each line, or each sentence of a line that is best as it is."""
        out, steps = [], []
        for line in text.split("\n"):
            if not line.isascii() or "&" in line:
                new, own = self.passage(line, lang) if line != text else (line, [])
                if not own:
                    parts = SENTENCE.findall(line)
                    if len(parts) > 1:
                        got = [self.passage(p, lang) for p in parts]
                        new, own = "".join(p for p, _ in got), [s for _, x in got for s in x]
                line = new
                steps += own
            out.append(line)
        return "\n".join(out), steps

    def lost(self, text: str, lang: str) -> bool:
        """Whether a text, or a line of it, is described by fewer bytes as one whose bytes were lost at some places.

        As it is, replacement characters are part of it, and those in words or runs, or alone for a third time and more, are oddities;
        as one with losses it is the text without them and the cost of a loss.
        """
        for part in [text, *text.split("\n")] if "\ufffd" in text else ():
            gaps = len(LOST.findall(part))
            if gaps:
                rest = LOST.sub("", part)
                shown = min(self.length(part, x) for x in {lang, "en"}) + ODD_COST * max(sum(map(len, TORN.findall(part))), gaps - 2)
                if min(self.length(rest, x) for x in {lang, "en"}) + LOST_COST < shown:
                    return True
        return False


#: Documents of a language that a dictionary is trained on, characters of each, and bytes of a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1200, 2000, 48_000


def tag(c: Column) -> Column:
    """language() inside the JVM."""
    code = F.substring(F.lower(F.trim(c)), 1, 2)
    return F.when(code.isin(*LETTERS, *SCRIPTS), code)


def train(docs: DataFrame, key: str, text: str, lang: str, seed: int = 5) -> Restorer:
    """Dictionaries from at most SAMPLE_DOCS documents of each language, chosen by a hash of their key.

    Sampled texts with characters foreign to their language are left out, so that garbled ones hardly get in.
    """
    code = tag(F.col(lang))
    sized = docs.select(code.alias("lang"), F.substring(F.col(text), 1, SAMPLE_CHARS).alias("text"), F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("h")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    n = {r["lang"]: r["n"] for r in sized.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    keep = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(int(min(1.0, SAMPLE_DOCS / v) * 2**62)))]) if n else F.create_map(F.lit(""), F.lit(0))
    few = sized.where(F.pmod("h", F.lit(2**62)) < keep[F.col("lang")]).select("lang", "text")
    samples: dict[str, list[bytes]] = {}
    blank = Restorer({})
    for x, t in sorted((r["lang"], r["text"]) for r in few.collect()):
        if not blank.suspicious(t, x):
            samples.setdefault(x, []).append(t.encode())
    return Restorer({x: d for x, s in samples.items() if (d := dictionary(s))})


def dictionary(samples: list[bytes]) -> bytes | None:
    """A zstandard dictionary of samples, or their text where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        raw = b"\n".join(samples)[:DICTIONARY_BYTES]
        return raw if len(raw) >= 8 else None


def restore_texts(docs: DataFrame, key: str, text: str, lang: str, restorer: Restorer | None = None) -> DataFrame:
    """key, restored, steps of the documents that are garbled.

    Null and empty texts are sound. Where bytes are lost, '?' is among the steps and restored keeps the replacement
    characters. Repeated rows stay repeated; other columns are not read; an empty table gives none.
    """
    model = restorer or train(docs, key, text, lang)
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(docs[key].alias("k"), docs[text].alias("t"), docs[lang].alias("l")).where(F.col("t").isNotNull() & F.col("t").rlike("[^\\x00-\\x7f]|&[#A-Za-z]"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual = gc.get_threshold()
        gc.set_threshold(200_000, 20, 100)  # what is remembered are many objects, none of them part of a cycle
        try:
            for b in batches:
                got = [model.restore(t, x) for t, x in zip(b["t"], b["l"])]
                yield pd.DataFrame({"k": b["k"], "restored": [g[0] for g in got], "steps": [g[1] for g in got]})[[bool(g[1]) for g in got]]
        finally:
            gc.set_threshold(*usual)

    out = spread(src).mapInPandas(work, f"k {kind}, restored string, steps array<string>")
    return out.select(F.col("k").alias(key), "restored", "steps")
