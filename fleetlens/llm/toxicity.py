"""Toxicity scores from a Levenshtein automaton intersected with a lexicon trie.

The lexicon (words, and stems that stand for every word that begins with them)
is learned from labelled texts. Its trie is intersected with the Levenshtein
automaton of one edit and made deterministic, once, on the driver; executors
then run that table over all words of a slice of texts at once. Each hit is
weighed by its context: whether it stands inside quotation marks or close after
a word of reporting, and by the words around it, whose log-odds of standing
beside abuse are learned too. A logistic model over the hits of a text gives its
score. In scripts without spaces every letter begins a word of up to SPAN
letters, and terms are stems.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from . import kernels
from .sampling import held_out, sampled_texts
from .storage import free_name

#: Most labelled texts that are learned from.
MAX_LABELLED = 8000
#: Code points on either side of a hit that are looked at for quotation, reporting and context.
WINDOW = 48
#: Bytes of text whose words are held as arrays at once, but for a longer text.
SLICE_BYTES = 1 << 19
#: Letters of a word, and of the shortest stem, in scripts without spaces.
SPAN, SHORT_STEM = 4, 2
#: Code point ranges of scripts without spaces: South-East Asian ones, kana and Han.
UNSPACED = [(0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000)]
#: Texts that a word must stand beside a hit in before its log-odds count.
SUPPORT = 8
#: Words of reporting, fixed values.
REPORTING = frozenset("said says called call calls calling quoted quote quotes wrote writes word words term phrase slur insult".split())
QUOTES = "\"“”„«»‘"
FEATURES = ["exact", "fuzzy", "exact_quoted", "fuzzy_quoted", "any_exact", "any_fuzzy", "density", "context"]


@dataclass
class Automaton:
    """Deterministic table over code point classes; state 0 is dead, 1 the start."""

    alphabet: dict[str, int]
    table: np.ndarray
    #: For each state, the least edits at which a word that ends here matches (9: no match).
    edits: np.ndarray


def build_automaton(terms: list[str], edits: int = 1, min_fuzzy: int = 5) -> Automaton:
    """Trie of terms (a final "*" marks a stem) times the Levenshtein automaton, by subset construction.

    Terms shorter than min_fuzzy are matched without edits.
    """
    children: list[dict[str, int]] = [{}]
    ends: dict[int, bool] = {}
    room = [0]
    for term in sorted(set(terms)):
        word = term.rstrip("*")
        if not word:
            continue
        node, allowed = 0, edits if len(word) >= min_fuzzy else 0
        room[0] = max(room[0], allowed)
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                room.append(0)
            node = children[node][c]
            room[node] = max(room[node], allowed)
        ends[node] = ends.get(node, False) or term.endswith("*")
    letters = sorted({c for node in children for c in node})
    alphabet = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other

    def close(states: dict[int, int]) -> dict[int, int]:
        """With letters of the term skipped; each node with its least edits. Stems that are reached stay so (-1 - edits)."""
        todo = list(states.items())
        while todo:
            node, e = todo.pop()
            if node < 0:
                continue
            for child in children[node].values():
                if e + 1 <= room[child] and states.get(child, 9) > e + 1:
                    states[child] = e + 1
                    todo.append((child, e + 1))
        for node, e in list(states.items()):
            if node >= 0 and ends.get(node):
                states[-1] = min(states.get(-1, 9), e)
        return states

    def step(states: dict[int, int], c: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, e in states.items():
            if node < 0:
                out[node] = min(out.get(node, 9), e)
                continue
            for letter, child in children[node].items():
                cost = e + (letter != c)
                if cost <= room[child]:
                    out[child] = min(out.get(child, 9), cost)
            if e + 1 <= room[node]:
                out[node] = min(out.get(node, 9), e + 1)
        return close(out)

    begin = tuple(sorted(close({0: 0}).items()))
    index, rows, best, todo = {(): 0, begin: 1}, {0: [0] * (len(letters) + 1)}, {0: 9}, [begin]
    while todo:
        key = todo.pop()
        states = dict(key)
        row = []
        for c in [None, *letters]:
            to = tuple(sorted(step(states, c).items()))
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append(index[to])
        rows[index[key]] = row
        best[index[key]] = min([9, *(e for n, e in states.items() if n < 0 or n in ends)])
    size = len(index)
    return Automaton(alphabet, np.array([rows[i] for i in range(size)], np.int32).reshape(size, -1), np.array([best[i] for i in range(size)], np.int8))


_kinds: np.ndarray | None = None


def _kind() -> np.ndarray:
    """Of each code point: 1 letters and digits, 2 those of scripts without spaces, 0 others."""
    global _kinds
    if _kinds is None:
        _kinds = np.array([chr(i).isalnum() for i in range(0x110000)], np.int8)
        for low, high in UNSPACED:
            _kinds[low:high] *= 2
    return _kinds


def lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, and their offsets."""
    low = [t.lower() for t in texts]
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate(([0], np.cumsum([len(t) for t in low], dtype=np.int64)))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row of each run of letters and digits, and of up to SPAN letters from each one of an unspaced script."""
    kind = _kind()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True

    def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1 : len(data)]
        ends[:-1] &= ~inside[1:] | edge[1 : len(data)]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    start, end = runs(kind == 1)
    if (kind == 2).any():
        begin, stop = runs(kind == 2)
        each = np.flatnonzero(kind == 2)
        until = np.minimum(each + SPAN, stop[np.searchsorted(begin, each, "right") - 1])
        start, end = np.concatenate((start, each)), np.concatenate((end, until))
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _classes(a: Automaton, data: np.ndarray) -> np.ndarray:
    """The automaton's class of each code point."""
    letters = np.array(sorted(map(ord, a.alphabet)) or [0], np.uint32)
    direct = np.zeros(0x3000, np.int32)
    low = letters[letters < 0x3000]
    if a.alphabet:
        direct[low] = np.arange(1, len(low) + 1)
    coded = direct[np.minimum(data, 0x2FFF)]
    if len(high := np.flatnonzero(data >= 0x3000)):
        at = np.minimum(np.searchsorted(letters, data[high]), len(letters) - 1)
        coded[high] = np.where(letters[at] == data[high], at + 1, 0)
    return coded


def find(a: Automaton, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least edits at which each word matches a term, 9 where none does."""
    state = np.ones(len(start), np.int32)
    live, at = np.arange(len(start)), start.copy()
    coded = _classes(a, data)
    while len(live):
        to = a.table[state[live], coded[at[live]]]
        state[live] = to
        at[live] += 1
        live = live[(to > 0) & (at[live] < end[live])]
    return a.edits[state]


def _around(data: np.ndarray, low: int, start: int, end: int, high: int) -> tuple[list[str], list[str]]:
    """The words of the window before and after a hit; those that the window cuts are left out."""
    text = lambda x: "".join(map(chr, x))
    return text(data[low:start]).split()[1 if low else 0 :], text(data[end:high]).split()[:-1]


def hit_features(a: Automaton, texts: list[str], context: dict[str, float] | None = None, seen: Counter | None = None) -> np.ndarray:
    """FEATURES of each text; seen: is told the (row, word) of what stands around hits outside quotation."""
    data, offsets = lowered(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    if not len(data):
        return out
    start, end, row = word_spans(data, offsets)
    edits = find(a, data, start, end)
    hits = np.flatnonzero(edits < 9)
    opened = np.concatenate(([0], np.cumsum(np.isin(data, [ord(c) for c in QUOTES]))))
    for i in hits:
        r = row[i]
        low, high = max(offsets[r], start[i] - WINDOW), min(offsets[r + 1], end[i] + WINDOW)
        before, after = opened[start[i]] - opened[offsets[r]], opened[high] - opened[end[i]]
        near = opened[start[i]] - opened[low]
        said, next_ = _around(data, low, start[i], end[i], high)
        quoted = (before % 2 == 1 and near > 0 and after > 0) or bool(REPORTING & set(said))
        out[r, (edits[i] > 0) + 2 * quoted] += 1
        around = {w.strip(".,;:!?") for w in (*said, *next_)}
        if seen is not None:
            seen.update((int(r), w) for w in around)
        if context:
            out[r, 7] += sum(context.get(w, 0.0) for w in around)
    n = np.maximum(np.bincount(row, minlength=len(texts)), 1)
    total = out[:, :4].sum(1)
    out[:, 4], out[:, 5] = (out[:, 0] + out[:, 2]) > 0, (out[:, 1] + out[:, 3]) > 0
    out[:, 6] = np.sqrt(total / n)
    out[:, 7] = np.clip(out[:, 7] / np.maximum(total, 1), -4, 4)
    out[:, :4] = np.log1p(out[:, :4])
    return out


def learn_context(a: Automaton, texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Log-odds of toxicity of words that stand around hits in SUPPORT texts or more, drawn to those of all hits by SUPPORT texts."""
    bad, good = Counter(), Counter()
    sums = [0, 0]
    for at, text in enumerate(texts):
        seen: Counter = Counter()
        if hit_features(a, [text], seen=seen)[0, 4:6].any():
            sums[int(toxic[at])] += 1
            (bad if toxic[at] else good).update(w for _, w in seen)
    if not all(sums):
        return {}
    share = sums[1] / sum(sums)
    out = {}
    for w in {*bad, *good}:
        if w and bad[w] + good[w] >= SUPPORT:
            p = (bad[w] + SUPPORT * share) / (bad[w] + good[w] + SUPPORT)
            out[w] = math.log(p / (1 - p)) - math.log(share / (1 - share))
    return {w: round(x, 6) for w, x in sorted(out.items()) if abs(x) > 0.5}


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Words and stems ("stem*", of 4 to 7 letters, or 2 to 4 of an unspaced script) that mark toxic texts.

    Texts with the same smallest word hash (copies, most near copies) count as
    one, and words in quotation don't count. A term is taken if 95 % of what has
    it is toxic, and if so many toxic
    texts would hardly (one term in two lexicons) meet in it by chance, and
    they are 2 % of the toxic ones. A stem gives way to a longer one, or to a
    word, with 0.8 of its texts.
    """
    def terms(text: str) -> set[str]:
        """Words that stand outside of quotation and reporting at least once."""
        data, offsets = lowered([text])
        whole = text.lower()
        if not len(data):
            return set()
        start, end, _ = word_spans(data, offsets)
        words = [whole[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        opened = np.concatenate(([0], np.cumsum(np.isin(data, [ord(c) for c in QUOTES]))))
        before, near, after = opened[start], opened[start] - opened[np.maximum(start - WINDOW, 0)], opened[np.minimum(end + WINDOW, len(data))] - opened[end]
        told = np.array([e for w, e in zip(words, end.tolist(), strict=True) if w in REPORTING], np.int64)
        reported = np.searchsorted(told, start, "right") > np.searchsorted(told, start - WINDOW, "left")
        plain = ~((before % 2 == 1) & (near > 0) & (after > 0)) & ~reported
        return {w for w, p in zip(words, plain.tolist(), strict=True) if p}

    def families(bad: bool) -> Iterator[set[str]]:
        """The words of each family; one family is held at a time."""
        own = [t for t, b in zip(texts, toxic, strict=True) if bool(b) == bad]
        names = [min((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in terms(t)), default=0) for t in own]
        order = sorted(range(len(own)), key=names.__getitem__)
        for _, run in groupby(order, key=names.__getitem__):
            yield set().union(*(terms(own[i]) for i in run))

    def with_stems(words: set[str]) -> set[str]:
        spaced = {w for w in words if _kind()[ord(w[0])] == 1}
        return spaced | {w[:k] + "*" for w in spaced for k in range(4, min(7, len(w)) + 1)} | {w[:k] + "*" for w in words - spaced for k in range(SHORT_STEM, len(w) + 1)}

    in_toxic: Counter = Counter()
    bad_families = good_families = 0
    for words in families(True):
        bad_families += 1
        in_toxic.update(with_stems(words))
    in_all = Counter({t: n for t, n in in_toxic.items() if n >= 4})
    for words in families(False):
        good_families += 1
        in_all.update(t for t in with_stems(words) if t in in_all)
    if not bad_families or not good_families:
        return []
    need = max(4.0, np.log(2 * len(in_toxic)) / -np.log(bad_families / (bad_families + good_families)), 0.02 * bad_families)
    good = {t: n for t, n in in_toxic.items() if n >= need and n >= 0.95 * in_all[t] and (len(t.rstrip("*")) >= 3 or _kind()[ord(t[0])] == 2)}
    longest = max((len(t) for t in good), default=0)
    kept: dict[str, int] = {}
    for n in range(longest, 0, -1):  # long terms first, words before stems of their length
        for t in sorted((t for t in good if len(t.rstrip("*")) == n), key=lambda t: t.endswith("*")):
            stem = t.rstrip("*")
            if t.endswith("*") and any(k.startswith(stem) and kept[k] >= 0.8 * good[t] for k in kept):
                continue
            kept[t] = good[t]
    for t in [t for t in kept if t.endswith("*")]:  # what a stem covers needs no term of its own
        for k in [k for k in kept if k != t and k.startswith(t[:-1]) and kept[k] < 0.8 * kept[t]]:
            del kept[k]
    return sorted(kept, key=lambda t: (-kept[t], t))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with an L2 penalty on the weights."""
    xb = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(xb.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        move = np.linalg.solve((xb.T * (p * (1 - p))) @ xb + penalty, xb.T @ (p - y) + penalty @ w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    lexicon: list[str]
    weights: np.ndarray
    bias: float
    context: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"lexicon": self.lexicon, "weights": self.weights.tolist(), "bias": self.bias, "context": self.context})

    @classmethod
    def from_json(cls, text: str) -> ToxicityModel:
        read = json.loads(text)
        return cls(read["lexicon"], np.array(read["weights"]), read["bias"], read["context"])


def learn(texts: list[str], toxic: np.ndarray) -> ToxicityModel:
    """A model from labelled texts; if they have only one class, or no term marks the toxic ones, nothing is toxic."""
    nothing = ToxicityModel([], np.zeros(len(FEATURES)), -4.0)
    if not 0 < toxic.sum() < len(toxic):
        return nothing
    lexicon = learn_lexicon(texts, toxic)
    if not lexicon:
        return nothing
    half = np.arange(len(texts)) % 2 == 0
    # the weights are fitted on hits of a lexicon and a context that haven't seen the text
    x = np.zeros((len(texts), len(FEATURES)))
    for part in (half, ~half):
        rest = [t for t, p in zip(texts, part, strict=True) if not p]
        other = build_automaton(learn_lexicon(rest, toxic[~part]))
        context = learn_context(other, rest, toxic[~part])
        x[part] = np.concatenate([hit_features(other, [t], context) for t, p in zip(texts, part, strict=True) if p])
    weights, bias = fit_logistic(x, toxic)
    return ToxicityModel(lexicon, weights, bias, learn_context(build_automaton(lexicon), texts, toxic))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """A model from at most max_labelled texts whose crc32(doc_id) mod 5 isn't 0 (hash order).

    Where no label is at hand, nothing is toxic. One task learns from the sample,
    which sampled_texts bounds; only the model comes to the driver.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True)), key=lambda r: r[0])
        model = learn([t for _, t, _ in rows], np.array([y for *_, y in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array([model.to_json()])], names=["model"])

    told = sampled_texts(docs, labels, "toxic", max_labelled).coalesce(1).mapInArrow(run, "model string").collect()
    return ToxicityModel.from_json(told[0].model) if told else learn([], np.zeros(0))


def scored(model: ToxicityModel, text: Column) -> Column:
    """struct<score double, hits long> of each text; only the text goes to Python, the row's other columns don't."""
    automaton, weights, bias, context = build_automaton(model.lexicon), model.weights, model.bias, model.context

    @F.arrow_udf("struct<score:double,hits:bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            p, hits = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for at, end, _, _ in kernels.slices(texts, SLICE_BYTES):
                x = hit_features(automaton, [t or "" for t in texts.slice(at, end - at).to_pylist()], context)
                p[at:end] = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
                hits[at:end] = np.expm1(x[:, :4]).sum(1).round().astype(np.int64)
            yield pa.StructArray.from_arrays([pa.array(p), pa.array(hits)], ["score", "hits"])

    return run.asNondeterministic()(text)  # so that it isn't run once for each use of its result


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score double (toxic probability), hits (terms found, with edits).

    Null and empty texts have no hits and get the score of a text without any.
    Rows are scored one by one, so repeats score alike; null ids are kept.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", scored(model, F.col("text")).alias("s")).select("doc_id", "s.score", "s.hits")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """docs without the rows scored at the threshold or above; all columns stay as they are, whatever they are called."""
    ship(docs.sparkSession)
    name = free_name(docs, "toxicity")
    return docs.withColumn(name, scored(model, F.col("text"))).filter(F.col(name)["score"] < threshold).drop(name)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out (false for a null id), score, predicted, hits."""
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
