"""Problem 3: the language of each text, and of each segment of a text that mixes several.

Prediction by partial matching over bytes. For every language a tree of contexts of up to ``ORDER`` bytes is counted on a
bounded sample of labelled texts and then frozen. A byte costs the bits of its share in the longest context that knows it,
plus the bits of an escape (method C) from each longer context that does not. The trees of all languages are kept as one
sorted table per order, so a batch of words is priced for all languages by a few binary searches. Words are priced by
themselves, which is why a batch prices each of its distinct words once.

The cheapest language is the text's. A text is mixed if paying for switches between words is cheaper than any one language;
segments too short to tell from a name, a title or a borrowed word go to their neighbours.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from wordtide.functions import patterns as P
from wordtide.llm import encoding_repair as ER
from wordtide.llm import normal_form as NF

LANGUAGES = ("en", "es", "pt", "fr", "de", "id", "tr", "ru", "ar", "hi", "ja", "ko")
#: Bytes of context at most.
ORDER = 4
#: Labelled texts of a language that are learnt from; the sample is the same for the same table.
SAMPLE = 150
#: Texts with fewer letters have no language.
LEAST_LETTERS = 12
#: Bits that a change of language within a text costs.
SWITCH = 22.0
#: Bits that a letter costs a language that is not written in its script, above the dearest that is. Names and borrowed
#: words in Latin letters are common in all languages and cost none.
FOREIGN = 4.0
#: An escape is at least this likely, so that templates in the sample do not make every other word dear.
LEAST_ESCAPE = 1 / 8
#: Share of a language's letters that must be of a script for it to be one of its own.
SCRIPT_SHARE = 0.2
#: Letters with their marks, and words unless the script has none, that a segment needs. Only Latin is the script of several
#: languages; where the script tells the language, ``LEAST_LETTERS`` are enough.
SEGMENT_LETTERS, SEGMENT_WORDS, DENSE_LETTERS = 20, 5, 7
#: Words in small letters that a segment in Cyrillic needs if it is no address: no other language is written in it, and names
#: have capitals.
CYRILLIC_WORDS = 2
#: Bits are divided by this before they become a confidence; neighbouring bytes are not independent.
TEMPERATURE = 4.0

# A usual way to write Russian in Latin letters, which the labelled texts lack.
ROMAN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i j k l m n o p r s t u f kh ts ch sh sch  y  e yu ya".split(" "), strict=True))
RUSSIAN_ADDRESS = frozenset(
    "ул улица улице улицы д дом доме дома кв квартира квартире пр просп проспект проспекте пер переулок переулке пл площадь площади наб набережная набережной "
    "ш шоссе бул бульвар бульваре корп корпус к стр строение офис подъезд этаж г город городе обл область пос посёлок индекс ящик".split()
)
# End of the fixed values.
_DENSE = "぀-ヿ㐀-鿿々"
_MARKS = "\u0300-\u036f\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963"
_LETTER = rf"(?:[^\W\d_{_DENSE}가-힣ᄀ-ᇿ]|[{_MARKS}])"
_WORD = re.compile(rf"[{_DENSE}]+|[가-힣ᄀ-ᇿ]+|{_LETTER}+(?:['’]{_LETTER}+)*")
_ENTITY = re.compile(rf"https?://\S+|www\.\S+|(?:bit\.ly|t\.co|goo\.gl)/\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[@#][^{P.SPACES}@#]+")
_PAYLOAD = re.compile(P.PAYLOAD_LINE)
#: Characters of garbled text that are rare in proper text; where one occurs, repair is tried.
_SUSPECT = re.compile("[\x80-\x9fÃÂÐÑØÙÅÄÏÎÌ¤¦©ªº‚„ƒ†‡√∂∑∏≠π╨╤├┤┬│─╬╧ΓΣΘπτφþðÝýÒÚÞÆ³¾±¸ЂЃѓЌЋ™�â]|[A-Za-z][б-яЁё]|[б-я][a-z]|[А-ЯЁ]{3}|[À-ÿ]{4}")


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    kept = set(NF.CYRILLIC[0])
    return str.maketrans({a: b for a, b in NF._alike().items() if a not in kept} | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)})


_TO_LATIN = str.maketrans(*NF.CYRILLIC)
_TO_CYRILLIC = str.maketrans("aceopxyABCEHKMOPTXYijsIJS", "асеорхуАВСЕНКМОРТХУіјѕІЈЅ")
_MIXED = re.compile(r"[^\W\d_]*(?:[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ])[^\W\d_]*")


_PLAIN_LATIN = re.compile("[A-Za-z]")
_OWN_CYRILLIC = re.compile(f"(?![{NF.CYRILLIC[0]}])[Ѐ-ӿ]")
_ALL_ALIKE = re.compile(rf"(?<![^\W\d_])[{NF.CYRILLIC[0]}]+(?![^\W\d_])")


def _one_script(m: re.Match) -> str:
    """A word of mixed Latin and Cyrillic in the script that all its letters can be of; Latin if both can."""
    latin = m[0].translate(_TO_LATIN)
    if not re.search("[Ѐ-ӿ]", latin):
        return latin
    cyrillic = m[0].translate(_TO_CYRILLIC)
    return latin if re.search("[A-Za-zÀ-ɏ]", cyrillic) else cyrillic


def prepare(text: str) -> str:
    """What is looked at: repaired if garbled, look-alikes and width folded, entities and payload blank."""
    if not text.isascii():
        if _SUSPECT.search(text):
            text = ER.restore(text)[0]
        text = unicodedata.normalize("NFC", _PAYLOAD.sub(_blank, text).translate(_fold_table()))
        if _MIXED.search(text):
            text = _MIXED.sub(_one_script, text)
            # Words of look-alikes alone belong to the script of all the rest.
            if len(_PLAIN_LATIN.findall(text)) > len(_OWN_CYRILLIC.findall(text)):
                text = _ALL_ALIKE.sub(lambda m: m[0].translate(_TO_LATIN), text)
    return _ENTITY.sub(_blank, text).replace("’", "'")


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


def origins(text: str) -> list[tuple[int, int]] | None:
    """For each character of the prepared text the part of the text that it comes from; None if the text was repaired."""
    if text.isascii():
        return [(i, i + 1) for i in range(len(text))]
    out: list[tuple[int, int]] = []
    parts, at, table = [], 0, _fold_table()
    while at < len(text):
        end = at + 1
        while end < len(text) and (unicodedata.combining(text[end]) or text[end] in NF.joining()):
            end += 1
        parts.append(unicodedata.normalize("NFC", text[at:end].translate(table)))
        out += [(at, end)] * len(parts[-1])
        at = end
    # All else that preparing does keeps the number of characters.
    same = "".join(parts) == unicodedata.normalize("NFC", text.translate(table)) and len(prepare(text)) == len(out)
    return out if same and not (_SUSPECT.search(text) and ER.restore(text)[0] != text) else None


def words(prepared: str) -> list[str]:
    return _WORD.findall(prepared)


def script(word: str) -> str:
    """The script of a word's first letter."""
    c = word[0]
    if c < "ʰ":
        return "latin"
    for name, low, high in (("cyrillic", "Ѐ", "ӿ"), ("arabic", "\u0600", "ۿ"), ("devanagari", "ऀ", "ॿ"), ("hangul", "가", "힣"), ("hangul", "ᄀ", "ᇿ")):
        if low <= c <= high:
            return name
    return "kana" if _dense(word) else "other"


def _codes(listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, each between blanks, and where each word begins."""
    raw = [b" " + w.encode("utf-8", "replace") + b" " for w in listed]
    starts = np.cumsum([0, *map(len, raw)])[:-1]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), starts


def _grams(listed: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For every order the key of each byte with its context, -1 where the word has not begun early enough; owners."""
    data, starts = _codes(listed)
    owner = np.repeat(np.arange(len(listed)), np.diff([*starts, len(data)]))
    depth = np.arange(len(data)) - starts[owner]
    keys, key, shift = [], data.astype(np.int64), 0
    for n in range(ORDER + 1):
        if n:
            shift += 8
            before = np.zeros(len(data), dtype=np.int64)
            before[n:] = data[:-n]
            key = key + (before << shift)
        keys.append(np.where(depth >= n, key, -1))
    # The leading blank is context only.
    return keys, np.where(depth > 0, owner, -1)


class Model:
    """Frozen trees of all languages: for each order sorted keys and a row of bits for each language."""

    def __init__(self, languages: list[str], grams: list, contexts: list, scripts: dict[str, list[int]]):
        self.languages, self.grams, self.contexts, self.scripts = languages, grams, contexts, scripts

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def _price(self, keys: list[np.ndarray], top: int) -> np.ndarray:
        """Bits of each byte for each language, from order ``top`` down."""
        n = len(keys[0])
        bits = np.zeros((n, len(self.languages)), dtype=np.float32)
        open_ = np.arange(n)
        for order in range(top, -1, -1):
            if not len(open_):
                return bits
            key = keys[order][open_]
            at, hit = self._find(self.grams[order][0], key)
            bits[open_[hit]] += self.grams[order][1][at[hit]]
            open_, key = open_[~hit], key[~hit]
            at, hit = self._find(self.contexts[order][0], np.where(key < 0, -1, key >> 8))
            bits[open_[hit]] += self.contexts[order][1][at[hit]]
        bits[open_] += 8.0
        return bits

    def word_bits(self, listed: list[str]) -> np.ndarray:
        """Bits of each word for each language."""
        out = np.zeros((len(listed), len(self.languages)), dtype=np.float32)
        for i in range(0, len(listed), 20_000):  # bounds the memory of long batches
            keys, owner = _grams(listed[i : i + 20_000])
            inside = owner >= 0
            bits = self._price([k[inside] for k in keys], ORDER)
            owner = owner[inside]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(first):
                out[i + owner[first]] = np.add.reduceat(bits, first, axis=0)
        # A language that is not written in a word's script has no say in it: all such cost as much as the dearest that is.
        by_script: dict[str, list[int]] = {}
        for i, w in enumerate(listed):
            by_script.setdefault(script(w), []).append(i)
        for name, at in by_script.items():
            own = self.scripts.get(name)
            if own:
                rest = [i for i in range(len(self.languages)) if i not in own]
                part = out[at]
                letters = np.array([len(listed[i]) for i in at], dtype=np.float32)
                part[:, rest] = part[:, own].max(1, keepdims=True) + (FOREIGN * letters * (name != "latin"))[:, None]
                out[at] = part
        return out


def train(texts: dict[str, list[str]]) -> Model:
    """A model from labelled texts; Russian also as written in Latin letters.

    Texts quote other languages, a closing line for instance. So a first model judges every line, and the lines that it
    surely finds to be of another language than their text are left out of the second, which is the result.
    """
    lines = {language: list(dict.fromkeys(line for t in own for line in t.split("\n") if line.strip())) for language, own in texts.items()}
    listed = {line: words(prepare(line)) for own in lines.values() for line in own}
    occurring = {language: [w for t in own for line in t.split("\n") for w in listed.get(line, ())] for language, own in texts.items()}
    first, left_out = _count(occurring), {}
    for language, own in lines.items():
        found = classify(first, own, listed)
        left_out[language] = {line for line, f in zip(own, found, strict=True) if f and f[1] >= 0.9 and (f[0] != language or f[2])}
    return _count({language: [w for t in own for line in t.split("\n") if line not in left_out[language] for w in listed.get(line, ())] for language, own in texts.items()})


def _count(occurring: dict[str, list[str]]) -> Model:
    """A model from the words of each language, as often as they occur."""
    languages = list(occurring)
    per_language = []
    scripts: dict[str, list[int]] = {}
    for at, language in enumerate(languages):
        listed = [w.lower() for w in occurring[language]]
        if language == "ru":
            listed += [roman for w in listed if (roman := "".join(ROMAN.get(c, c) for c in w)) != w]
        counts: Counter = Counter()
        for w in listed:
            counts[script(w)] += len(w)
        for name, n in counts.items():
            if n >= SCRIPT_SHARE * counts.total():
                scripts.setdefault(name, []).append(at)
        listed = [w for w in listed if at in scripts.get(script(w), [])]
        keys, owner = _grams(listed) if listed else ([np.empty(0, np.int64)] * (ORDER + 1), np.empty(0, np.int64))
        per_language.append([np.unique(k[(k >= 0) & (owner >= 0)], return_counts=True) for k in keys])
    grams: list = []
    contexts: list = []
    model = Model(languages, grams, contexts, scripts)
    for order in range(ORDER + 1):
        union = np.unique(np.concatenate([x[order][0] for x in per_language]))
        above = np.unique(union >> 8)
        rows = np.zeros((len(union), len(languages)), dtype=np.float32)
        escapes = np.zeros((len(above), len(languages)), dtype=np.float32)
        if order:
            lower = [union & ((1 << 8 * (n + 1)) - 1) for n in range(order)]
            fallback = model._price(lower, order - 1)
        else:
            fallback = np.full(rows.shape, 8.0, dtype=np.float32)
        for i, counted in enumerate(per_language):
            key, count = counted[order]
            ctx, where = np.unique(key >> 8, return_inverse=True)
            total = np.bincount(where, weights=count, minlength=len(ctx)) if len(key) else np.zeros(0)
            kinds = np.bincount(where, minlength=len(ctx)) if len(key) else np.zeros(0)
            leave = np.maximum(kinds / (total + kinds), LEAST_ESCAPE)
            escape = np.zeros(len(above), dtype=np.float32)
            escape[np.searchsorted(above, ctx)] = -np.log2(leave)
            escapes[:, i] = escape
            column = fallback[:, i] + escape[np.searchsorted(above, union >> 8)]
            column[np.searchsorted(union, key)] = -np.log2(count / total[where] * (1 - leave[where])) if len(key) else 0
            rows[:, i] = column
        grams.append((union, rows))
        contexts.append((above, escapes))
    return model


def sample(df: DataFrame, key: str, text: str, label: str, size: int = SAMPLE) -> dict[str, list[str]]:
    """Up to ``size`` whole texts of each language, those with the smallest hash of their key.

    The bound is what reaches the driver; the limit within each label is pushed below the shuffle, and only keys are ranked.
    """
    code = F.lower(F.regexp_extract(F.col(label), "^[A-Za-z]+", 0))
    rows = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), code.alias("code")).where(F.col("code").isin(*LANGUAGES))
    rank = F.row_number().over(W.partitionBy("code").orderBy(F.xxhash64("k"), "k"))
    chosen = rows.withColumn("n", rank).where(F.col("n") <= size).select("k", "code")
    got = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").orderBy("k").collect()
    out: dict[str, list[str]] = {language: [] for language in LANGUAGES}
    for r in got:
        out[r["code"]].append(r["t"])
    return out


def _letters(listed: list[str]) -> int:
    return sum(c.isalpha() for w in listed for c in w)


def _size(listed: list[str]) -> int:
    """Letters and the marks that belong to them, such as the vowel signs of Devanagari."""
    return sum(len(w) - w.count("'") for w in listed)


def _paths(bits: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The cheapest languages of the words of each text when a switch costs ``SWITCH``; all texts at once, word by word."""
    n, most = len(starts), int(lengths.max())
    best = bits[starts].copy()
    came = np.zeros((most, n, bits.shape[1]), dtype=np.int8)
    own = np.arange(bits.shape[1], dtype=np.int8)
    for t in range(1, most):
        on = np.flatnonzero(lengths > t)
        cheapest = best[on].argmin(1)
        other = best[on, cheapest] + SWITCH
        stay = best[on] <= other[:, None]
        came[t, on] = np.where(stay, own, cheapest[:, None].astype(np.int8))
        best[on] = np.where(stay, best[on], other[:, None]) + bits[starts[on] + t]
    out = []
    for i in range(n):
        path = np.empty(lengths[i], dtype=np.int8)
        now = best[i].argmin()
        for t in range(lengths[i] - 1, -1, -1):
            path[t] = now
            now = came[t, i, now]
        out.append(path)
    return out


def _dense(word: str) -> bool:
    return word[0] >= "぀"


def _segments(path: np.ndarray, listed: list[str], bits: np.ndarray) -> list[tuple[int, int, int]]:
    """(from word, to word, language): runs of the path, those too short to stand alone given to their neighbours."""
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
    runs = [(int(a), int(b), int(path[a])) for a, b in zip(cuts, cuts[1:], strict=False)]

    shouting = sum(w.isupper() for w in listed) > len(listed) / 2

    def stands(a: int, b: int, language: int) -> bool:
        """Long enough, not made of the capitals of names, titles and streets, and by more than a few of its words."""
        part = listed[a:b]
        dense = [w for w in part if _dense(w)]
        if dense and _letters(dense) >= DENSE_LETTERS:
            return True
        letters: Counter = Counter()
        for w in part:
            letters[script(w)] += len(w)
        main = letters.most_common(1)[0][0]
        plain = [w for i, w in enumerate(part) if script(w) == main and (shouting or not i or not w[0].isupper())]
        own = [w for w in part if script(w) == "cyrillic"]
        if main == "cyrillic" and sum(w[0].islower() for w in own) >= CYRILLIC_WORDS and _size(own) >= LEAST_LETTERS and not RUSSIAN_ADDRESS.intersection(map(str.lower, own)):
            return True
        others = [r for r in runs if r[2] != language]
        other = max(others, key=lambda r: r[1] - r[0])[2]
        wins = int((bits[a:b, language] < bits[a:b, other] - 0.5).sum())
        least = SEGMENT_LETTERS if main == "latin" else LEAST_LETTERS
        return len(plain) >= SEGMENT_WORDS and _size(part) >= least and wins >= SEGMENT_WORDS - 1

    kept = [r for r in runs if stands(*r)]
    if not kept:
        whole = int(bits.sum(0).argmin())
        return [(0, len(path), whole)]
    merged: list[list[int]] = []
    for a, b, language in kept:
        if merged and merged[-1][2] == language:
            merged[-1][1] = b
        else:
            merged.append([a if merged else 0, b, language])
    for left, right in zip(merged, merged[1:], strict=False):
        left[1] = right[0]
    merged[-1][1] = len(path)
    return [(a, b, language) for a, b, language in merged]


def _confidence(bits: np.ndarray, language: int) -> float:
    """How sure a language is, given the bits of all."""
    e = np.exp(-(bits - bits.min()) * (np.log(2) / TEMPERATURE))
    return float(e[language] / e.sum())


def classify(model: Model, texts: list[str | None], known: dict[str, list[str]] | None = None) -> list[tuple[str, float, list[tuple]] | None]:
    """For each text (language, confidence, segments), or None for null and for too few letters. Equal texts once.

    The language of a mixed text is that of its longest segment, and the confidence that segment's. A segment is (language,
    confidence, words, start, end); the bounds are those of the text as it stands, None if it had to be repaired. ``known``
    are the words of texts, if they were taken before.
    """
    places: dict[str, int] = {}
    for t in texts:
        if t is not None:
            places.setdefault(t, len(places))
    distinct = list(places)
    listed = [known[t] if known else words(prepare(t)) for t in distinct]
    enough = [i for i, ws in enumerate(listed) if _letters(ws) >= LEAST_LETTERS]
    vocabulary: dict[str, int] = {}
    ids = [vocabulary.setdefault(w.lower(), len(vocabulary)) for i in enough for w in listed[i]]
    results: list = [None] * len(places)
    if enough:
        bits = model.word_bits(list(vocabulary))[ids]
        lengths = np.array([len(listed[i]) for i in enough])
        starts = np.cumsum([0, *lengths])[:-1]
        total = np.add.reduceat(bits, starts, axis=0)
        # Where free switching would not pay for one switch, no path with switches is the cheapest.
        free = np.add.reduceat(bits.min(1), starts)
        maybe = np.flatnonzero(total.min(1) - free > SWITCH)
        paths = dict(zip(maybe, _paths(bits, starts[maybe], lengths[maybe]), strict=True)) if len(maybe) else {}
        names = model.languages
        for n, i in enumerate(enough):
            best = int(total[n].argmin())
            sure, segments = _confidence(total[n], best), []
            if n in paths and paths[n].min() != paths[n].max():
                own = bits[starts[n] : starts[n] + lengths[n]]
                found = _segments(paths[n], listed[i], own)
                first, last, best = max(found, key=lambda s: _size(listed[i][s[0] : s[1]]))
                sure = _confidence(own[first:last].sum(0), best)
                if len({s[2] for s in found}) > 1:
                    text = distinct[i]
                    where, came = [m.span() for m in _WORD.finditer(prepare(text))], origins(text)
                    bounds = [(came[where[a][0]][0], came[where[b - 1][1] - 1][1]) if came else (None, None) for a, b, _ in found]
                    segments = [(names[s], _confidence(own[a:b].sum(0), s), " ".join(listed[i][a:b]), *at) for (a, b, s), at in zip(found, bounds, strict=True)]
            results[i] = (names[best], sure, segments)
    return [None if t is None else results[places[t]] for t in texts]


_FIELDS = ("lang", "confidence", "text", "start", "stop")
_KINDS = (T.StringType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.IntegerType())
_SEGMENT = T.StructType([T.StructField(n, k) for n, k in zip(_FIELDS, _KINDS, strict=True)])
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("segments", T.ArrayType(_SEGMENT))])
_ARROW = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("segments", pa.list_(pa.struct(list(zip(_FIELDS, (pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32()), strict=True)))))])


def identify(df: DataFrame, model: Model, text: str = "desc", out: str = "language") -> DataFrame:
    """Adds a struct ``out`` (lang, confidence, segments): segments only for texts that mix languages, in order, each with its
    place in the text (from ``start`` to before ``stop``, in code points).

    Null for null texts and for texts of fewer than ``LEAST_LETTERS`` letters outside entities. Rows and all other columns
    stay as they are; nothing is shuffled. The model is broadcast; its size is bounded by the sample it was learnt from.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at, names = df.columns.index(text), [*df.columns, out]
    schema = T.StructType([*df.schema.fields, T.StructField(out, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = classify(shared.value, batch.column(at).to_pylist())
            rows = [None if g is None else {"lang": g[0], "confidence": g[1], "segments": [dict(zip(_FIELDS, s, strict=True)) for s in g[2]]} for g in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=names)

    return df.mapInArrow(run, schema)


def label_problems(df: DataFrame, model: Model, key: str = "row_id", text: str = "desc", label: str = "lang") -> DataFrame:
    """(key, lang): the true language of texts whose label is missing or wrong, and every language of mixed texts."""
    found = identify(df.select(key, text, label), model, text, "_found").where(F.col("_found").isNotNull())
    code = F.lower(F.regexp_extract(F.col(label), "^([^-_]*)", 1))
    several = F.array_distinct(F.col("_found.segments.lang"))
    one = F.when(code.eqNullSafe(F.col("_found.lang")), F.array().cast("array<string>")).otherwise(F.array("_found.lang"))
    return found.select(key, F.explode(F.when(F.size(several) > 1, several).otherwise(one)).alias("lang"))
