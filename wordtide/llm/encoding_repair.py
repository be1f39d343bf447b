"""Problem 7: text that was decoded with the wrong character encoding.

Garbled sequences are computed beforehand for all pairs of an encoding and the one it was taken for, and found by
Aho-Corasick automata in the texts that hold a telling pair of characters at all. Four kinds of pairs:

* UTF-8 taken for a single-byte encoding: one unit for every character of ``BLOCKS``. Most hold a character that no proper
  text has there; those that could be proper (a capital before a quote) count only beside other evidence. Text that went
  through it twice is searched again.
* Cyrillic, Arabic, Japanese or Korean encodings taken for a Western one: single units prove nothing, so only unbroken
  chains of them count, and the source is the one whose letters are the most usual.
* Western encodings taken for another single-byte one: foreign letters or signs inside a word of Latin letters. Cyrillic and
  Greek letters that look like Latin ones prove nothing unless another word of the text can't be read as look-alikes.
* Cyrillic encodings taken for each other: words whose case is turned.

Matched spans, and no others, are turned back. What was lost in decoding shows as U+FFFD: such text counts as garbled too,
but only what can be is restored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtide.functions import patterns as P
from wordtide.llm.normal_form import CYRILLIC, GREEK, char_class

# Encodings, and the blocks of characters that texts of the twelve languages use.
UTF8_AS = ("cp1252", "latin-1", "cp1254", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "cp1250", "cp1256", "iso8859-15", "koi8-r")
BLOCKS = (
    (0x00A0, 0x017F),  # Latin
    (0x0218, 0x021B),  # Latin, Romanian
    (0x0300, 0x0328),  # accents
    (0x0400, 0x045F), (0x0490, 0x0491),  # Cyrillic
    (0x060C, 0x066D), (0x0670, 0x06D5),  # Arabic
    (0x0900, 0x097F),  # Devanagari
    (0x2010, 0x2060), (0x20A0, 0x20BF), (0x2100, 0x214F),  # punctuation, currencies, letterlike
    (0x2190, 0x23FF), (0x2500, 0x27BF), (0x2B00, 0x2BFF),  # arrows to symbols
    (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF01, 0xFFEE),  # CJK
    (0x1F1E6, 0x1F1FF), (0x1F300, 0x1F6FF), (0x1F900, 0x1FAFF),  # emoji
)
#: Source, its letters, its most usual letters, units that a chain must have.
WESTERN_READS = (
    ("cp1251", (0x0410, 0x0451), "оеаинтсрвлкмдпу", 4),
    ("koi8-r", (0x0410, 0x0451), "оеаинтсрвлкмдпу", 4),
    ("cp1256", (0x060C, 0x0652), "اليمونرتبةعد", 4),
    ("shift_jis", (0x3001, 0x9FFF), "のいとでまだしてなすをにがたはんうるりか", 3),
    ("euc_jp", (0x3001, 0x9FFF), "のいとでまだしてなすをにがたはんうるりか", 3),
    ("cp949", (0xAC00, 0xD7A3), "이다는을를고에가요서하지게어기도나리자만", 2),
)
LATIN_READ_AS = ("cp850", "cp437", "cp1251", "mac_roman", "cp866", "koi8-r", "cp1250", "cp1252")
LATIN_SOURCES = {"cp1252": ("cp1254",)}  # otherwise cp1252 is the source
ALPHABETS = "àáâãäçèéêëìíîïñòóôõöùúûüÿœæßğışâîû"
CONTEXT = "\xa0«»‘’“”–—…¡¿·„"
LOOKALIKE_LATIN = "aceopxyisjhbkmtnABCEHIJKMNOPSTXYZ"
LOOKALIKE_OTHER = "асеорхуіѕјһԁӏАВСЕНІЈКМОРЅТХУοιναρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧкмтнвгьЬ"
# End of the fixed values.
LOST = "\ufffd"
_PAYLOAD = re.compile(P.PAYLOAD_LINE)


@lru_cache(maxsize=None)
def _decoder(codec: str) -> list[str]:
    """Characters of the 256 bytes; a byte that the encoding leaves undefined keeps its number, as lenient decoders do."""
    return [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]


def _read(raw: bytes, codec: str) -> str:
    table = _decoder(codec)
    return "".join(table[b] for b in raw)


def _encode(c: str, codec: str) -> bytes:
    try:
        return c.encode(codec)
    except UnicodeEncodeError:
        return b""


# --- UTF-8 taken for a single-byte encoding


def _proper(c: str) -> bool:
    """Whether a letter or sign is at home in texts of the twelve languages, beside other letters."""
    return c in CONTEXT or c.lower() in ALPHABETS or "А" <= c <= "я" or c in "Ёё" or c in LOOKALIKE_OTHER or "ء" <= c <= "ي" or c in "،؛؟"


@lru_cache(maxsize=1)
def _utf8() -> list[ahocorasick.Automaton]:
    own = {c for codec in UTF8_AS for c in _decoder(codec) if ord(c) > 127}
    chars = [*dict.fromkeys([*(chr(i) for a, b in BLOCKS for i in range(a, b + 1)), *sorted(own)])]
    raws = [(c, raw) for c in chars if len(raw := c.encode("utf-8")) > 1]
    out = []
    for codec in UTF8_AS:
        auto, table = ahocorasick.Automaton(), _decoder(codec)
        proper = [_proper(c) for c in table]
        for c, raw in raws:
            garbled = "".join([table[b] for b in raw])
            auto.add_word(garbled, (len(garbled), c, not all([proper[b] for b in raw])))
        auto.make_automaton()
        out.append(auto)
    return out


def _spans(text: str, found: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """Of units (start, end, character, strong) the unbroken runs that no proper text would hold."""
    runs, i = [], 0
    while i < len(found):
        j = i + 1
        while j < len(found) and found[j][0] == found[j - 1][1]:
            j += 1
        start, end = found[i][0], found[j - 1][1]
        before, lead = text[start - 1 : start], text[start]
        after_capital = before.isalpha() and before.isupper()
        strong = any(x[3] for x in found[i:j])
        if strong and j - i == 1 and end - start == 2 and after_capital and text[end - 1] in "\xa0\xad":
            strong = False  # an invisible sign within capitals
        # Without a strong unit only a Latin capital inside a word, or several units from one on, are out of place, and
        # punctuation that shows as Cyrillic beside a Latin letter.
        taken = strong or ord(lead) < 0x250 and lead.isupper() and not after_capital
        if not taken and "Ѐ" <= lead <= "ӿ" and all("\u2010" <= x[2] <= "\u2060" for x in found[i:j]):
            taken = any(c.isascii() and c.isalpha() for c in before + text[end : end + 1])
        runs.append([start, end, "".join(x[2] for x in found[i:j]), taken, j - i > 1])
        i = j
    # Several weak units only a blank away from what is taken go with it.
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        for i in order:
            near = runs[i - 1] if order.step > 0 else runs[i + 1]
            gap = text[min(near[1], runs[i][1]) : max(near[0], runs[i][0])]
            if near[3] and runs[i][4] and len(gap) <= 2 and not any(map(str.isalpha, gap)):
                runs[i][3] = True
    return [(start, end, new) for start, end, new, taken, _ in runs if taken]


def _undo_utf8(text: str) -> tuple[str, int, int]:
    """One pass with the encoding that explains most of the text."""
    best: list[tuple[int, int, str]] = []
    covered = 0
    for auto in _utf8():
        found = [(last - n + 1, last + 1, c, strong) for last, (n, c, strong) in auto.iter_long(text)]
        spans = _spans(text, found) if found else []
        n = sum(end - start for start, end, _ in spans)
        if n > covered:
            best, covered = spans, n
    return _replaced(text, best), len(best), covered


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, new in spans:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


# --- other scripts taken for a Western encoding


@lru_cache(maxsize=1)
def _chains() -> list[tuple[str, ahocorasick.Automaton, str, int]]:
    out = []
    for source, (low, high), usual, least in WESTERN_READS:
        auto = ahocorasick.Automaton()
        for c in map(chr, range(low, high + 1)):
            raw = _encode(c, source)
            if raw and raw[0] > 127:
                for codec in ("cp1252", "latin-1"):
                    garbled = _read(raw, codec)
                    auto.add_word(garbled, (len(garbled), c))
        auto.make_automaton()
        out.append((source, auto, usual, least))
    return out


_UPPER_HALF = "".join(sorted({c for codec in ("cp1252", "latin-1") for c in _decoder(codec)[128:]}))
_RUN = re.compile(f"[{re.escape(_UPPER_HALF)}]{{3}}")


def _undo_western(text: str) -> tuple[str, int, int]:
    if not _RUN.search(text):
        return text, 0, 0
    best, result = 0.0, (text, 0, 0)
    for _, auto, usual, least in _chains():
        chains: list[list[tuple[int, int, str]]] = []
        for last, (n, c) in auto.iter_long(text):
            if chains and chains[-1][-1][1] == last - n + 1:
                chains[-1].append((last - n + 1, last + 1, c))
            else:
                chains.append([(last - n + 1, last + 1, c)])
        if max(map(len, chains), default=0) < least:
            continue
        spans = [(x[0][0], x[-1][1], "".join(c for _, _, c in x)) for x in chains]
        letters = "".join(x[2] for x in spans)
        common = sum(c.lower() in usual for c in letters)
        turned = sum(a.islower() and b.isupper() for _, _, x in spans for a, b in zip(x, x[1:], strict=False))
        covered = sum(end - start for start, end, _ in spans)
        score = (common - 2 * turned) / len(letters) * covered
        if common >= 0.25 * len(letters) and score > best:
            best, result = score, (_replaced(text, spans), len(spans), covered)
    return result


# --- Western encodings taken for another


@lru_cache(maxsize=1)
def _foreign() -> list[tuple[str, dict[str, str]]]:
    out = []
    for codec in LATIN_READ_AS:
        for source in LATIN_SOURCES.get(codec, ("cp1252",)):
            letters = ALPHABETS + ALPHABETS.upper() + "’¡¿…"
            table = {_read(raw, codec): c for c in letters if len(c) == 1 and len(raw := _encode(c, source)) == 1}
            out.append((codec, {g: c for g, c in table.items() if g != c}))
    return out


_WORD = re.compile(r"[^\s\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f]+")
_PLAIN_LATIN = re.compile(r"[a-zA-Z]")


def _signs(word: str) -> set[str]:
    """Letters and signs of a word of Latin letters that can't be its own."""
    if word.isascii() or not _PLAIN_LATIN.search(word):
        return set()
    odd, latin = set(), any(c.isascii() and c.isalpha() and c not in LOOKALIKE_LATIN for c in word)
    for i, c in enumerate(word):
        if c.isascii() or c == "’":
            continue
        before, after = word[i - 1 : i], word[i + 1 : i + 2]
        low_before, low_after = before.isascii() and before.islower(), not after or after.isascii() and after.islower()
        if "Ͱ" <= c <= "ӿ":
            if latin and c not in LOOKALIKE_OTHER:
                odd.add(c)
        elif c.isalpha() and ord(c) < 0x250:
            if c.lower() not in ALPHABETS and c not in "ªº" and (low_before or low_after and after):
                odd.add(c)
            elif c.isupper() and low_before and low_after:
                odd.add(c)
        elif low_before and after and low_after and not c.isalnum() and c in _SIGNS or c in "³¾" and low_before and after and low_after:
            odd.add(c)
    return odd


_FOREIGN_LETTER = re.compile("[Ͱ-ӿ]")
_TO_LATIN = str.maketrans(CYRILLIC[0] + GREEK[0], CYRILLIC[1] + GREEK[1])
#: Latin letters that stand for the letters of Russian.
_TO_RUSSIAN = str.maketrans({b: a for a, b in zip(*CYRILLIC, strict=True) if a in "АВЕКМНОРСТУХасеорух"})
_CASE_TURNED = re.compile("[^\\W\\d_A-Z][A-Z]")


def _alike_only(word: str) -> bool:
    """Whether a word of mixed scripts is one of a single script in which some letters were changed for look-alikes."""
    if not re.search("[A-Za-z]", word.translate(_TO_RUSSIAN)):
        return True
    latin = word.translate(_TO_LATIN)
    return not _FOREIGN_LETTER.search(latin) and not (_CASE_TURNED.search(latin) and not _CASE_TURNED.search(_FOREIGN_LETTER.sub("", word)))


def _mixed_signs(words: list[str]) -> set[str]:
    """Foreign letters of the words of mixed scripts that no look-alikes explain, in a text that is mostly in Latin letters,
    if a reading turns these words into wholly Latin ones."""
    mixed = [w for w in words if _FOREIGN_LETTER.search(w) and _PLAIN_LATIN.search(w) and not _alike_only(w)]
    if not mixed:
        return set()
    text = "".join(words)
    if len(_PLAIN_LATIN.findall(text)) <= len(_FOREIGN_LETTER.findall(text)):
        return set()
    return {c for w in mixed for _, table in _foreign() if not _FOREIGN_LETTER.search("".join([table.get(c, c) for c in w])) for c in w if _FOREIGN_LETTER.match(c)}


_SIGNS = "".join({g for codec in LATIN_READ_AS for g in _decoder(codec)[128:] if not g.isalnum()} - set(CONTEXT) - set("\xa0\xad·²©®™°€"))


def _undo_latin(text: str) -> tuple[str, int, int]:
    words = _WORD.findall(text)
    signs = {c for w in words for c in _signs(w)} | _mixed_signs(words)
    if not signs:
        return text, 0, 0
    # The reading that explains all odd signs, and among these the one with the most small letters.
    turkish = len(signs & set("ýðÝÐ"))
    options = [(sum(c in table for c in signs), turkish * (codec == "cp1252"), sum(table.get(c, "").islower() for c in signs), -i, table) for i, (codec, table) in enumerate(_foreign())]
    known, *_, table = max(options, key=lambda x: x[:4])
    if not known:
        return text, 0, 0
    spans = 0
    # A letter of German in a text that otherwise turns out to be of another language is garbled as well.
    sharp = any(table.get(c, "") in "óíúñãõçéèê" for c in signs)

    def fix(m: re.Match) -> str:
        nonlocal spans
        word = m[0]
        other = any("Ͱ" <= c <= "ӿ" and c in table for c in word) and _PLAIN_LATIN.search(word)
        if not any(c in table for c in word) or not (_signs(word) or other or sharp and "ß" in word):
            return word
        spans += 1
        return "".join(table.get(c, c) for c in word)

    return _WORD.sub(fix, text), spans, 0


# --- Cyrillic encodings taken for each other

_TURNED = re.compile("[А-ЯЁ]?[а-яё]+[А-ЯЁ]{2,}")
_CYRILLIC_WORD = re.compile("[А-Яа-яЁёЈ]+")
_USUAL = "оеаинтсрвлкмдпу"


def _undo_cyrillic(text: str) -> tuple[str, int, int]:
    """Words whose case is turned, or words in capitals whose letters get usual only when read the other way."""
    if not _CYRILLIC_WORD.search(text):
        return text, 0, 0
    words = [w for w in _CYRILLIC_WORD.findall(text) if not w.islower() and len(w) > 1 and not w.istitle()]
    if not words:
        return text, 0, 0
    turned = sum(bool(_TURNED.fullmatch(w)) and len(w) > 2 for w in words)
    share = lambda s: sum(c in _USUAL for c in s.lower()) / len(s)
    raw, best = share("".join(words)), (text, 0, 0)
    for taken, source in (("cp1251", "koi8-r"), ("koi8-r", "cp1251")):
        other = "".join(_encode(w, taken).decode(source, "replace") for w in words)
        gain = share(other) - raw if other and LOST not in other else -1
        small = sum(c.islower() for c in other)
        if small >= 0.8 * len(other) and (turned and gain > 0 or gain > 0.2 and len(other) >= 12):
            fix = lambda m, t=taken, s=source: m[0] if m[0] not in words and not m[0].isupper() else _encode(m[0], t).decode(s, "replace")
            best = (_CYRILLIC_WORD.sub(fix, text), len(words), 0)
            raw = share(other)
    return best


# --- one text, and tables


@lru_cache(maxsize=1)
def candidate_pattern() -> str:
    """A Java pattern without which no text holds anything that ``restore`` looks for."""

    pairs = [char_class(_decoder(c)[0xC2:0xF5]) + char_class(_decoder(c)[0x80:0xC0]) for c in UTF8_AS]
    strange = {g for _, table in _foreign() for g in table if not g.isascii() and g.lower() not in ALPHABETS and g not in CONTEXT}
    capitals = {g for _, table in _foreign() for g in table if g.isupper() and not g.isascii()}
    foreign = "(?=[^\\x00-\\x7f])"  # plain characters, which are most, meet one test instead of all
    first = "|".join([LOST, *pairs, char_class(_UPPER_HALF) + "{3}", char_class(strange) + "[A-Za-z]", "[А-ЯЁЈ]{2}"])
    return f"{foreign}(?:{first})|[A-Za-z]{foreign}{char_class(strange | capitals)}"


def restore(text: str) -> tuple[str, int, bool]:
    """(restored text, spans replaced, whether something is lost for good). Pure of Spark, for one text."""
    body = _PAYLOAD.sub("", text)
    # A payload is no wrong decoding; it is taken out and put back.
    held = _PAYLOAD.findall(text)
    out, spans = "\x00\x00".join(_PAYLOAD.split(text)) if held else text, 0
    western = _undo_western(out)
    if western[2] > _undo_utf8(out)[2]:
        out, spans = western[:2]
    n = 1
    while n:  # each pass undoes one wrong decoding and shortens the text
        out, n, _ = _undo_utf8(out)
        spans += n
    for step in (_undo_latin, _undo_cyrillic):
        out, n, _ = step(out)
        spans += n
    for payload in held:
        out = out.replace("\x00\x00", payload, 1)
    return out, spans, LOST in body


_RESULT = T.StructType([T.StructField("restored", T.StringType()), T.StructField("spans", T.IntegerType()), T.StructField("lost", T.BooleanType())])


@F.pandas_udf(_RESULT)
def _restore(texts: pd.Series) -> pd.DataFrame:
    done = {t: restore(t) for t in texts.dropna().unique()}  # a few texts hold most rows
    return pd.DataFrame([(None, 0, False) if t is None else done[t] for t in texts], columns=["restored", "spans", "lost"])


def _may(c: Column) -> Column:
    """Whether the text may hold anything; plain ASCII, which never does, is passed by the cheaper test."""
    return c.rlike(r"[^\x00-\x7f]") & c.rlike(candidate_pattern())


def repair(df: DataFrame, text: str = "desc", out: str = "repaired") -> DataFrame:
    """Adds a struct ``out`` (restored, spans, lost): the text with its garbled spans turned back, how many there were, and
    whether part of the text can't be restored. Known corrupt payloads count as neither.

    Null gives null with no spans; texts without any telling pair never leave the JVM. All other columns stay as they are.
    """
    c: Column = F.col(text)
    may = _may(c)
    rows = df.withColumn("_garbled", _restore(F.when(may, c)))
    got = F.struct(
        F.when(may, F.col("_garbled.restored")).otherwise(c).alias("restored"),
        F.coalesce("_garbled.spans", F.lit(0)).alias("spans"),
        F.coalesce("_garbled.lost", F.lit(False)).alias("lost"),
    )
    return rows.withColumn(out, got).drop("_garbled")


def garbled_rows(df: DataFrame, text: str = "desc", out: str = "repaired") -> DataFrame:
    """The rows of ``repair`` that hold wrongly decoded text, restorable or not."""
    near = df.where(_may(F.col(text)))
    return repair(near, text, out).where((F.col(f"{out}.spans") > 0) | F.col(f"{out}.lost"))
