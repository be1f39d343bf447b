"""Problem 6: personal information in free text, replaced by placeholders of its type.

A linear-chain conditional random field tags the tokens of each text: words, runs of digits and single signs. Features are
a token's shape, its form, its ending, whether it is on the list of names and whether it is an ordinary word, seen from up
to ``REACH`` tokens away. It is trained by gradient on a small labelled table, and decoded by Viterbi over padded batches in
numpy. In training, forms are hidden at random, so that words which no table knows are judged by what stands around them.
Width, look-alike letters and kinds of digits and spaces are folded before tokens are looked at; the text itself is only
changed where a span is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtide.functions import patterns as P
from wordtide.llm import language_id as LI
from wordtide.llm import normal_form as NF
from wordtide.llm import tokens as TK
from wordtide.llm.pii_examples import KINDS, labelled, own_words

#: Labels: none, and for every kind its first token and the others.
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
REACH = 4
#: Distance up to which the form of a token counts; beyond it only its shape does.
NEAR = 2
#: Texts of the labelled table, lines of ordinary text in it, passes over it.
EXAMPLES, PLAIN_LINES, EPOCHS = 12000, 2000, 4
#: Whole labelled texts of a language from which the ordinary lines and words are taken.
PLAIN_TEXTS = 40
#: In training, the share of tokens whose form is hidden but for its ending, and of a name's tokens that are hidden whole.
HIDDEN, HIDDEN_NAMES = 0.4, 0.5
#: Added to what speaks for a span at its first token: a value that is missed costs more than a needless placeholder.
CAUTION = np.array([0.0 if label[0] != "B" else 1.5 if label == "B-name" else 1.0 for label in LABELS], dtype=np.float32)
_LETTERS = rf"(?:[^\W\d_]|[{LI._MARKS}])+(?:['’](?:[^\W\d_]|[{LI._MARKS}])+)*"
_TOKEN = re.compile(rf"{P.PAYLOAD_LINE}|https?://\S+|www\.(?![^\s/]*@)\S+|(?<![\w.+-])[@#][^\s@#]+(?:#[^\s@#]*)*|{_LETTERS}|\d+|[^\w\s]|_")
_SUFFIX = 3


@lru_cache(maxsize=1)
def _fold() -> tuple[dict[int, str], set[str]]:
    """What each character is folded to, always one for one, and the invisible ones, which are left out."""
    alike = NF._alike()
    gone = {c for c, to in alike.items() if not to}
    table = {a: b for a, b in alike.items() if b and a not in set(NF.CYRILLIC[0])}
    table |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    for zero in (0x0660, 0x06F0, 0x0966):
        table |= {chr(zero + i): str(i) for i in range(10)}
    return str.maketrans(table), gone


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, folded token); the bounds are those of the text as it stands."""
    if text.isascii():
        return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    table, gone = _fold()
    places = [i for i, c in enumerate(text) if c not in gone]
    folded = "".join(text[i] for i in places).translate(table) if len(places) < len(text) else text.translate(table)
    if LI._MIXED.search(folded):
        folded = LI._MIXED.sub(lambda m: LI._one_script(m), folded)
    if len(places) == len(text):
        return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(folded)]
    return [(places[m.start()], places[m.end() - 1] + 1, m[0]) for m in _TOKEN.finditer(folded)]


def _shape(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return f"d{min(len(token), 12)}"
    if c == "\ufffd" and len(token) > 1:
        return "link"
    if c.isalpha() or len(token) > 1 and c not in "@#":
        if token.startswith(("http", "www.")) and len(token) > 5 and "." in token:
            return "link"
        case = "l" if token.islower() else "U" if token.isupper() and len(token) > 1 else "C" if c.isupper() and (len(token) == 1 or token[1:].islower()) else "m"
        return f"{case}{1 if len(token) == 1 else 2 if len(token) == 2 else 3 if len(token) == 3 else 4}{'c' if 'Ѐ' <= c <= 'ӿ' else '' if c < 'ʰ' else 'o'}"
    return "handle" if len(token) > 1 else c


_JOINTS = set("+-./()")
_PLAIN_RUN = str.maketrans("", "", " -.z")


def described(found: list[tuple[int, int, str]], text: str) -> list[tuple[str, bool, str]]:
    """For each token its form, whether a space or the beginning is before it, and the shape of the number that it is a part
    of: the lengths of its groups of digits and letters, what joins them, and whether it begins with zero. Numbers end with their line."""
    out = [(t, i == 0 or found[i - 1][1] < a, "") for i, (a, _, t) in enumerate(found)]
    i = 0
    while i < len(found):
        if not (found[i][2][0].isdigit() or found[i][2] in "+(" or _code(found[i][2])):
            i += 1
            continue
        j = i
        while j < len(found) and (j == i or "\n" not in text[found[j - 1][1] : found[j][0]]) and (found[j][2][0].isdigit() or found[j][2] in _JOINTS or _code(found[j][2])):
            j += 1
        last = j
        while last > i and not found[last - 1][2][0].isalnum():
            last -= 1
        part = found[i:last]
        if any(t[0].isdigit() for _, _, t in part):
            shape = "".join((" " if k and out[i + k][1] else "") + (str(len(t)) if t[0].isdigit() else "A" * len(t) if t[0].isalpha() else t) for k, (_, _, t) in enumerate(part))
            lead = next(t for _, _, t in part if t[0].isdigit())[0] == "0"
            for k in range(i, last):
                out[k] = (*out[k][:2], shape[:24] + ("z" if lead else ""))
        i = j
    return out


def _code(token: str) -> bool:
    """Whether a token may be the letters of a code."""
    return len(token) <= 2 and token.isalpha() and token.isascii() and token.isupper()


def features(token: str, spaced: bool, run: str, hidden: int, names: dict[str, str], ordinary: set[str]) -> list[str]:
    """Shapes first, which count at any distance, then forms, which count nearby."""
    low, shape = token.lower(), _shape(token)
    out = [f"s={shape}{int(spaced)}", f"s={shape}"]
    if shape[0] == "d" or run:
        return [*out, f"r={run.rstrip('z')}", f"z={run}", "", f"c={run.translate(_PLAIN_RUN)}"]
    if shape in ("link", "handle") or len(token) == 1 and not token.isalpha():
        return [*out, "", "", "", ""]
    if hidden > 1:
        return [*out, f"k=0{shape}", "", "", ""]
    known = int(low in ordinary)
    name = f"n={names[low]}{shape[0]}{known}" if low in names else ""
    return [*out, f"k={known}{shape}", "" if hidden else f"w={low}", f"e={low[-_SUFFIX:]}", name]


_PER_TOKEN, _SHAPES = 6, 3


class Tagger:
    """Weights of the chain: for each feature and offset a row of labels, and a matrix between neighbouring labels."""

    def __init__(self, names: dict[str, str], ordinary: set[str] = frozenset()):
        self.names, self.ordinary, self.index = names, ordinary, {"": 0, "pad": 1}
        self.weights = np.zeros((2, 2 * REACH + 1, len(LABELS)), dtype=np.float32)
        self.between = np.zeros((len(LABELS), len(LABELS)), dtype=np.float32)

    def _ids(self, listed: list[list[tuple]], grow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids of the distinct tokens; the texts as their numbers between pads; starts; lengths.

        A token is as ``described`` gives it and, in training, how much of its form is hidden.
        """
        distinct: dict[tuple, int] = {}
        flat = [0] * REACH
        starts, lengths = [], []
        for text in listed:
            starts.append(len(flat))
            lengths.append(len(text))
            for t in text:
                flat.append(distinct.setdefault(t, len(distinct) + 1))
            flat += [0] * REACH
        table = np.zeros((len(distinct) + 1, _PER_TOKEN), dtype=np.int64)
        table[0, 0] = 1
        for (token, spaced, run, *hidden), row in distinct.items():
            for j, f in enumerate(features(token, spaced, run, sum(hidden), self.names, self.ordinary)):
                table[row, j] = self.index.setdefault(f, len(self.index)) if grow and f else self.index.get(f, 0)
        return table, np.array(flat), np.array(starts), np.array(lengths)

    def _scores(self, table: np.ndarray) -> np.ndarray:
        """For each token and offset what the token says of the labels so far from it."""
        out = self.weights[table[:, :_SHAPES]].sum(1)
        out[:, REACH - NEAR : REACH + NEAR + 1] += self.weights[:, REACH - NEAR : REACH + NEAR + 1][table[:, _SHAPES:]].sum(1)
        return out

    def _emissions(self, table: np.ndarray, flat: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flat), len(LABELS)), dtype=np.float32)
        scores = self._scores(table)
        for o in range(2 * REACH + 1):
            shift = o - REACH
            if shift >= 0:
                out[: len(flat) - shift] += scores[flat[shift:], o]
            else:
                out[-shift:] += scores[flat[:shift], o]
        return out

    # --- training

    def train(self, examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, batch: int = 200, rate: float = 0.25, decay: float = 1e-5) -> None:
        """AdaGrad on the log-likelihood, on the features that a batch has; the weights are the mean of those after every
        batch but the first epoch's. The order is fixed, so equal tables give equal taggers."""
        listed, gold, r = [], [], np.random.default_rng(0)
        for text, spans in examples:
            found = tokens(text)
            if found:
                labels = _gold(found, spans)
                names = labels > 2 * KINDS.index("name")
                small = np.array([t.islower() for _, _, t in found])
                hidden = np.where(names & ~small, 2 * (r.random(len(found)) < HIDDEN_NAMES), r.random(len(found)) < HIDDEN).tolist()
                listed.append([(*t, h) for t, h in zip(described(found, text), hidden, strict=True)])
                gold.append(labels)
        table, flat, starts, lengths = self._ids(listed, True)
        self.weights = np.zeros((len(self.index), 2 * REACH + 1, len(LABELS)), dtype=np.float32)
        total, total_between, n = np.zeros_like(self.weights), np.zeros_like(self.between), 0
        seen, seen_between = np.full_like(self.weights, 1e-4), np.full_like(self.between, 1e-4)
        by_length = np.argsort(lengths, kind="stable")  # texts of a length share a batch, batches come in random order
        for epoch in range(epochs):
            first = int(r.integers(batch))
            cuts = [0, *range(first, len(by_length), batch), len(by_length)]
            bounds = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            for at in r.permutation(len(bounds)):
                chosen = by_length[slice(*bounds[at])]
                own, g, pairs = self._gradient(table, flat, starts[chosen], lengths[chosen], [gold[i] for i in chosen])
                mine = self.weights[own]
                g = g / len(chosen) + decay * mine
                squares = seen[own] + g * g
                seen[own] = squares
                self.weights[own] = mine - rate * g / np.sqrt(squares)
                pairs = pairs / len(chosen)
                seen_between += pairs * pairs
                self.between -= rate * pairs / np.sqrt(seen_between)
                if epoch or epochs == 1:
                    total += self.weights
                    total_between += self.between
                    n += 1
        self.weights, self.between = total / max(1, n), total_between / max(1, n)
        self.weights[0] = 0

    def _gradient(self, table, flat, starts, lengths, gold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the features that occur, and the gradient of their weights and of ``between``."""
        most, count, n = int(lengths.max()), len(starts), len(LABELS)
        steps = np.arange(most)
        on = steps[None, :] < lengths[:, None]
        at = np.minimum(starts[:, None] + steps[None, :], len(flat) - 1 - REACH)
        window = at[:, :, None] + np.arange(-REACH, REACH + 1)
        kinds, where = np.unique(flat[window], return_inverse=True)  # distinct tokens of the batch
        where = where.reshape(window.shape)
        table = table[kinds]
        e = np.zeros((count, most, n), dtype=np.float64)
        scores = self._scores(table)
        for o in range(2 * REACH + 1):
            e += scores[where[:, :, o], o]
        # Forward and backward in probabilities, scaled at every step.
        b = np.exp(self.between.astype(np.float64))
        e = np.exp(e - e.max(2, keepdims=True))
        forward, scale = np.empty_like(e), np.ones((count, most, 1))
        x = e[:, 0]
        for t in range(most):
            if t:
                x = np.where(on[:, t, None], (forward[:, t - 1] @ b) * e[:, t], forward[:, t - 1])
            scale[:, t] = np.where(on[:, t, None], x.sum(1, keepdims=True), 1.0)
            forward[:, t] = x / scale[:, t]
        backward, pairs = np.ones_like(e), np.zeros_like(b)
        for t in range(most - 1, 0, -1):
            x = e[:, t] * backward[:, t] / scale[:, t] * on[:, t, None]
            pairs += forward[:, t - 1].T @ x
            backward[:, t - 1] = np.where(on[:, t, None], x @ b.T, 1.0)
        pairs *= b
        share = forward * backward * on[:, :, None]
        for i, labels in enumerate(gold):
            share[i, np.arange(len(labels)), labels] -= 1
            np.add.at(pairs, (labels[:-1], labels[1:]), -1)
        own, feature = np.unique(table, return_inverse=True)
        feature = feature.reshape(table.shape)
        rows, offsets = share[on], 2 * REACH + 1
        per_token = np.stack([_sums(where[:, :, o][on], rows, len(kinds)) for o in range(offsets)], 1)
        g = np.zeros((len(own), offsets, n))
        far = per_token.reshape(len(kinds), -1)
        for j in range(_SHAPES):
            g += _sums(feature[:, j], far, len(own)).reshape(g.shape)
        near = slice(REACH - NEAR, REACH + NEAR + 1)
        close = np.ascontiguousarray(per_token[:, near]).reshape(len(kinds), -1)
        for j in range(_SHAPES, _PER_TOKEN):
            g[:, near] += _sums(feature[:, j], close, len(own)).reshape(len(own), -1, n)
        g[own == 0] = 0
        g = g.astype(np.float32)
        return own, g, pairs.astype(np.float32)

    # --- decoding

    def labels(self, listed: list[list[tuple[str, bool]]]) -> list[np.ndarray]:
        """The best labels of each text's tokens; texts of about equal length go through the chain together."""
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(listed)
        order = sorted((i for i, t in enumerate(listed) if t), key=lambda i: len(listed[i]))
        at = 0
        while at < len(order):
            group, size = [], 0
            while at < len(order) and (not group or (len(group) + 1) * len(listed[order[at]]) <= 60_000):
                group.append(order[at])
                at += 1
            table, flat, starts, lengths = self._ids([listed[i] for i in group], False)
            scores = self._emissions(table, flat)
            scores += CAUTION
            for i, path in zip(group, self._viterbi(scores, starts, lengths), strict=True):
                out[i] = path
        return out

    def _viterbi(self, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        most, count = int(lengths.max()), len(starts)
        best = e[starts].copy()
        came = np.zeros((most, count, len(LABELS)), dtype=np.int8)
        for t in range(1, most):
            x = best[:, :, None] + self.between
            came[t] = x.argmax(1)
            new = x.max(1) + e[np.minimum(starts + t, len(e) - 1)]
            best = np.where((lengths > t)[:, None], new, best)
        path = np.zeros((count, most), dtype=np.int8)
        now, rows = best.argmax(1), np.arange(count)
        for t in range(most - 1, -1, -1):
            inside = lengths > t
            path[inside, t] = now[inside]
            now = np.where(inside, came[t][rows, now], now)
        return [path[i, : lengths[i]] for i in range(count)]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of what is found in each text, in order."""
        found = [tokens(t) for t in texts]
        listed = [described(f, t) for f, t in zip(found, texts, strict=True)]
        out = []
        for f, path, text in zip(found, self.labels(listed), texts, strict=True):
            spans: list[tuple[int, int, str]] = []
            i = 0
            while i < len(f):
                if path[i]:
                    kind, j = (path[i] - 1) // 2, i + 1
                    while j < len(f) and path[j] == 2 * kind + 2:
                        j += 1
                    if _plausible(KINDS[kind], [t for _, _, t in f[i:j]]):
                        spans.append((f[i][0], f[j - 1][1], KINDS[kind]))
                    i = j
                else:
                    i += 1
            out.append(spans)
        return out


def _sums(groups: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The rows summed by group."""
    width = rows.shape[1]
    at = (groups[:, None] * width + np.arange(width)).ravel()
    return np.bincount(at, weights=rows.ravel(), minlength=n * width).reshape(n, width)


def _gold(found: list[tuple[int, int, str]], spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(found), dtype=np.int64)
    for start, end, kind in spans:
        inside = [i for i, (a, b, _) in enumerate(found) if a < end and b > start]
        for n, i in enumerate(inside):
            out[i] = 1 + 2 * KINDS.index(kind) + (n > 0)
    return out


def _plausible(kind: str, parts: list[str]) -> bool:
    """What every value of a kind has, whatever its form."""
    digits = sum(c.isdigit() for t in parts for c in t)
    if kind == "email":
        return any(t == "@" or t.lower() == "at" for t in parts[1:])
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 6
    if kind == "address":
        return digits > 0 and parts[0][0].isalnum() and any(t.isalpha() and len(t) > 2 for t in parts) and all(t[0].isalnum() or t in ".,-'’º/ª#" for t in parts)
    return parts[0][0].isalpha() and all(t[0].isalpha() or t in ".,-'’" for t in parts)


def tagger(names: Iterable[tuple[str, str]], plain: Plain, examples: int = EXAMPLES, folder: str = TK.FOLDER) -> Tagger:
    """A trained tagger. ``names`` (name, kind) is a list of hints, known to be incomplete; ``plain`` is text without spans.
    Words are ordinary if they are small in that text or in the vocabulary of a public tokenizer, which lies in ``folder``."""
    listed = list(names)
    known = {w.lower(): kind for name, kind in listed for w in re.split(r"[\s-]", name) if len(w) > 2}
    hints = {kind: [name.title() if name.islower() or name.isupper() else name for name, k in listed if k == kind] for kind in ("given", "family")}
    made = Tagger(known, plain.words | own_words() | TK.small_words(folder))
    made.train(labelled(plain.lines, examples, hints))
    return made


class Plain(NamedTuple):
    """Ordinary text: lines, and the words that are written small in it."""

    lines: list[str]
    words: set[str]


_ORDINARY = re.compile(r"[^\W\d_]{2,}")


def plain_text(df: DataFrame, key: str, text: str, label: str, lines: int = PLAIN_LINES, texts: int = PLAIN_TEXTS) -> Plain:
    """Lines and words of ordinary text, from at most ``texts`` whole labelled texts of each language; the same for the same
    table. German words count with their capitals, inside a line."""
    per_language = LI.sample(df, key, text, label, texts)
    found = [s.strip() for own in per_language.values() for t in own for s in re.split(r"(?<=[.!?。])\s+|\n", t) if 10 < len(s) < 160]
    words = {w for own in per_language.values() for t in own for w in _ORDINARY.findall(t) if w.islower()}
    words |= {m[0].lower() for t in per_language["de"] for m in re.finditer(r"(?<=[a-zäöüß] )[^\W\d_]{2,}", t)}
    step = max(1, len(found) // lines) if lines else 1
    return Plain(found[::step][:lines], words)


def fit(documents: DataFrame, hints: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Tagger:
    """The tagger for these documents' ordinary text and a small list of hints (name, kind). Its size and the time it takes
    are bounded by ``EXAMPLES``, ``PLAIN_TEXTS`` and ``EPOCHS``, whatever the tables hold."""
    names = [(r["name"], r["kind"]) for r in hints.where("name IS NOT NULL").orderBy("name", "kind").collect()]
    return tagger(names, plain_text(documents, key, text, label))


def find(df: DataFrame, made: Tagger, text: str, out: str = "pii") -> DataFrame:
    """Adds a struct ``out`` (redacted, kinds): the text with each finding replaced by its type in brackets, and the kinds
    that occur. Null for null; texts without findings stay as they are. Rows and all other columns stay; nothing is
    shuffled. The tagger is broadcast; its size is bounded by its labelled table.
    """
    shared = df.sparkSession.sparkContext.broadcast(made)
    names, at = [*df.columns, out], df.columns.index(text)
    result = T.StructType([T.StructField("redacted", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    arrow = pa.struct([("redacted", pa.string()), ("kinds", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            distinct = list(dict.fromkeys(t for t in texts if t is not None))
            done = {}
            for t, spans in zip(distinct, shared.value.spans(distinct), strict=True):
                done[t] = {"redacted": redact(t, spans), "kinds": sorted({k for _, _, k in spans})}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if t is None else done[t] for t in texts], arrow)], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, result)]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``[KIND]`` in place of every span."""
    parts, at = [], 0
    for start, end, kind in spans:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def kinds(df: DataFrame, made: Tagger, key: str, text: str) -> DataFrame:
    """(key, kind): one row for each kind that occurs in a row's text."""
    return find(df.select(key, text), made, text, "_pii").select(key, F.explode("_pii.kinds").alias("kind"))
