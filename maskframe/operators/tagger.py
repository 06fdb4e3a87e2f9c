"""A sequence tagger for names: a hidden Markov model over word features, learned by counting and decoded by Viterbi.

The text is a row of words and signs. Each has a tag (outside, or first or further word
of a label) and shows features: the word, its neighbours, its ending and the shapes of
these. Training counts, in one pass over labelled rows, how often tags follow each other
and show each feature; tasks add up their own rows first and one aggregate adds up the
tasks. The most frequent features, a bounded number, make the model, a small object that
goes with the jobs that use it. A feature that the model doesn't have counts as unseen
with every tag.

A tagger is a scorer as :func:`~maskframe.operators.detect.score_chunks` takes one; with
labels PERSON and ORG it serves as the recogniser of these names.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features that a model keeps, by how often they occur; what is added to each count.
FEATURES, SMOOTHING = 100_000, 0.1
#: Most tags, in all.
TAGS = 10_000
#: Kinds of feature: word, words beside it, ending, own shape and those beside it.
KINDS = "wpneslr"
#: Different words whose features a task keeps.
WORDS = 300_000
OUTSIDE = "O"


class Numbers(dict):
    """A number for each different key, by first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Forms(dict):
    """The form of each character, by its code: capitals X, small letters x, digits 9, others themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = form = "9" if re.match(r"\d", c) else ("X" if c.isupper() else "x") if re.match(r"[^\W_]", c) else c
        return form


FORMS = Forms()
RUNS = re.compile(r"(.)\1{2,}")


@functools.lru_cache(1 << 16)
def shape(word: str) -> str:
    """Capitals as X, small letters as x, digits as 9, runs of more than two as two."""
    return RUNS.sub(r"\1\1", word.translate(FORMS))


def features(words: list[str]) -> list[list[str]]:
    """The features of each word, one of each kind."""
    shown = numbered(words, np.array([0, len(words)]))
    return [[f"{kind}{shown[kind][1][shown[kind][0][k]]}" for kind in KINDS] for k in range(len(words))]


def before(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The numbers of the words before those of ``own``, 0 at the beginning of a text."""
    out = np.concatenate([own[:0], [0], own[:-1]])[: len(own)]
    out[first[:-1][first[:-1] < first[1:]]] = 0
    return out


def behind(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The numbers of the words behind those of ``own``, 0 at the end of a text."""
    out = np.concatenate([own[1:], [0]])[: len(own)]
    out[first[1:][first[:-1] < first[1:]] - 1] = 0
    return out


def numbered(words: list[str], first: np.ndarray) -> dict[str, tuple[np.ndarray, list[str]]]:
    """For each kind of feature the number of its value at each word, and the different values.

    The words are those of several texts, one behind the other; ``first`` has the place of
    each text's first word, and their number. What a word shows is made once a different word.
    """
    known = Numbers()
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def shown(values: list[str]) -> tuple[np.ndarray, list[str]]:
        numbers = Numbers({"^": 0})
        own = np.fromiter(map(numbers.__getitem__, values), np.int64, len(values))
        return own[ids] if len(ids) else ids, list(numbers)

    lows = [w.lower() for w in known]
    low, all_lows = shown(lows)
    form, all_forms = shown([shape(w) for w in known])
    return {"w": (low, all_lows), "p": (before(low, first), all_lows), "n": (behind(low, first), all_lows), "e": shown([w[-3:] for w in lows]), "s": (form, all_forms), "l": (before(form, first), all_forms), "r": (behind(form, first), all_forms)}


@functools.cache
def classes() -> np.ndarray:
    """For each code point 0 for white space, 2 for what words are made of, 1 for signs."""
    every = "".join(map(chr, range(0x110000)))
    out = np.ones(len(every), np.uint8)
    for number, pattern in ((0, r"\s+"), (2, r"\w+")):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = number
    return out


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Begin and end of all words of the texts put together by line feeds, the words, the place of each text's first word, and each text's beginning.

    A word is a run of letters, digits and underscores, or one sign.
    """
    joined = "\n".join(texts)
    kind = np.concatenate([[0], classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)], [0]]).astype(np.uint8)
    own, part = kind[1:-1], kind == 2
    begin = np.flatnonzero((own == 1) | part[1:-1] & ~part[:-2])
    end = np.flatnonzero((own == 1) | part[1:-1] & ~part[2:]) + 1
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return begin, end, [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.searchsorted(begin, begins), begins


def in_parts(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts (from, to) of about ``most`` characters."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def tags_of(begin: np.ndarray, end: np.ndarray, first: np.ndarray, spans: list[tuple[int, int, int, str]], number: dict[str, int]) -> np.ndarray:
    """A tag's number for each word by the labelled spans (text, start, end, label; places as those of the words); of overlapping ones the first.

    ``number`` gets the tags that it doesn't have.
    """
    out = np.full(len(begin), number.setdefault(OUTSIDE, len(number)))
    if not spans:
        return out
    todo = sorted(spans, key=lambda s: s[:3])
    text, start, stop = (np.array([s[k] for s in todo], np.int64) for k in range(3))
    left = np.maximum(np.searchsorted(end, start, side="right"), first[text])
    right = np.minimum(np.searchsorted(begin, stop, side="left"), first[text + 1])
    upto = 0
    for a, b, (*_, label) in zip(left.tolist(), right.tolist(), todo, strict=True):
        a = max(a, upto)
        if a < b:
            out[a:b] = number.setdefault(f"I-{label}", len(number))
            out[a] = number.setdefault(f"B-{label}", len(number))
            upto = b
    return out


@dataclass
class Tagger:
    """A trained model. ``steps`` and ``opens`` are log probabilities of tags after tags and at the beginning, ``seen`` those of features by tag."""

    tags: list[str]
    opens: np.ndarray
    steps: np.ndarray
    seen: dict[str, np.ndarray]
    unseen: dict[str, np.ndarray] = field(default_factory=dict)
    tables: dict[str, tuple[dict[str, int], np.ndarray]] | None = field(default=None, init=False, repr=False, compare=False)
    #: Numbers of words met so far, and rows of what they show.
    kept: tuple[Numbers, np.ndarray] | None = field(default=None, init=False, repr=False, compare=False)

    def __getstate__(self) -> dict:
        """The features as one list and one table: thousands of small arrays are slow to send."""
        table = np.array(list(self.seen.values())).reshape(len(self.seen), len(self.tags))
        return {"tags": self.tags, "opens": self.opens, "steps": self.steps, "unseen": self.unseen, "names": list(self.seen), "table": table}

    def __setstate__(self, state: dict) -> None:
        names, table = state.pop("names"), state.pop("table")
        self.__dict__.update(state, seen=dict(zip(names, table, strict=True)), tables=None, kept=None)

    def _tables(self) -> dict[str, tuple[dict[str, int], np.ndarray]]:
        """For each kind of feature the rows of its values and the log probabilities by row; row 0 is that of unseen ones."""
        index, rows = {kind: {} for kind in KINDS}, {kind: [self.unseen[kind]] for kind in KINDS}
        for name, row in self.seen.items():
            index[name[0]][name[1:]] = len(rows[name[0]])
            rows[name[0]].append(row)
        return {kind: (index[kind], np.array(rows[kind]).reshape(-1, len(self.tags))) for kind in KINDS}

    def _rows(self, words: list[str]) -> np.ndarray:
        """For each kind of feature the row of what each different word shows of that kind."""
        lows, forms = [w.lower() for w in words], list(map(shape, words))
        values = {"w": lows, "p": lows, "n": lows, "e": [w[-3:] for w in lows], "s": forms, "l": forms, "r": forms}
        return np.array([[of(v, 0) for v in values[kind]] for kind in KINDS for of in [self.tables[kind][0].get]], np.int32)

    def _shown(self, words: list[str], first: np.ndarray) -> np.ndarray:
        """Log probability of each word's features by tag, for the words of several texts; what a word shows is kept for the next texts."""
        if self.tables is None:
            self.tables = self._tables()
        if self.kept is None or len(self.kept[0]) > WORDS:
            self.kept = Numbers({"^": 0}), self._rows(["^"])
        known, rows = self.kept
        own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > rows.shape[1]:
            rows = np.concatenate([rows, self._rows(list(itertools.islice(known, rows.shape[1], None)))], axis=1)
            self.kept = known, rows
        last, next_ = before(own, first), behind(own, first)
        out = np.zeros((len(words), len(self.tags)))
        for kind, ids in zip(KINDS, (own, last, next_, own, own, last, next_), strict=True):
            out += self.tables[kind][1].take(rows[KINDS.index(kind)].take(ids), axis=0)
        return out

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log probability of each word's features by tag."""
        return self._shown(words, np.array([0, len(words)]))

    def _decode(self, shown: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The most probable row of tags of each text; all texts go on by one word at a time, the longest ones last."""
        place, active = _in_steps(first)
        row = np.zeros(len(shown), np.int64)
        if not active:
            return row
        shown, ways = _moved(shown, place), self.steps[:, :, None]
        best, back, at = self.opens[:, None] + shown[:, : active[0]], [], active[0]
        for m in active[1:]:
            each = best[:, None, :m] + ways
            top, last = each.max(axis=0), np.zeros((len(self.tags), m), np.int16)
            for k in range(len(self.tags) - 1, -1, -1):  # of equal ones the first stays
                np.copyto(last, k, where=each[k] == top)
            back.append(last)
            best[:, :m] = top + shown[:, at : at + m]
            at += m
        now = np.argmax(best, axis=0)
        for m, last in zip(active[:0:-1], reversed(back), strict=True):
            at -= m
            row[at : at + m] = now[:m]
            now[:m] = last[now[:m], np.arange(m)]
        row[: active[0]] = now
        return row[place]

    def decode(self, words: list[str]) -> list[int]:
        """The most probable row of tags, by number; of equal ones the first by tag numbers from the end."""
        return self._decode(self.emissions(words), np.array([0, len(words)])).tolist()

    def _certainty(self, shown: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each tag at each word of several texts, by the forward and backward sums."""
        place, active = _in_steps(first)
        if not active:
            return np.empty_like(shown)
        shown = _moved(shown, place)
        ahead, later, ways, back = np.empty_like(shown), np.zeros_like(shown), _ways(self.steps), _ways(self.steps.T)
        ahead[:, : active[0]], at = self.opens[:, None] + shown[:, : active[0]], 0
        for m, more in zip(active, active[1:], strict=False):
            at += m
            ahead[:, at : at + more] = _summed(ahead[:, at - m : at - m + more], ways) + shown[:, at : at + more]
        at = shown.shape[1]
        for m, fewer in zip(active[:0:-1], active[-2::-1], strict=True):
            at -= m
            later[:, at - fewer : at - fewer + m] = _summed(shown[:, at : at + m] + later[:, at : at + m], back)
        both = ahead + later
        return np.exp(both - np.logaddexp.reduce(both, axis=0)).T[place]

    def certainty(self, words: list[str]) -> np.ndarray:
        """Probability of each tag at each word."""
        return self._certainty(self.emissions(words), np.array([0, len(words)]))

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of the labelled runs; the score is the least certainty of a tag in it."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """:meth:`spans` of each text, many at once."""
        out: list[list[tuple[int, int, str, float]]] = []
        for a, b in in_parts(texts):
            out += self._spans(texts[a:b])
        return out

    def _spans(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        begin, end, words, first, begins = words_of(texts)
        shown = self._shown(words, first)
        row = self._decode(shown, first)
        labelled = np.flatnonzero(row != self.tags.index(OUTSIDE))
        out: list[list] = [[] for _ in texts]
        if not len(labelled):
            return out
        some = np.unique(np.searchsorted(first, labelled, side="right") - 1)  # only these texts need certainties
        sizes = first[some + 1] - first[some]
        within = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.arange(within[-1]) + np.repeat(first[some] - within[:-1], sizes)
        sure = self._certainty(shown[taken], within)
        scores = sure[np.arange(len(taken)), row[taken]]
        held = np.flatnonzero(row[taken] != self.tags.index(OUTSIDE))
        at, text, scores = taken[held], np.repeat(some, sizes)[held], scores[held]
        opening = np.array([t.startswith("B-") for t in self.tags])[row[at]]
        opening[1:] |= text[1:] != text[:-1]
        opening[0] = True
        runs = np.flatnonzero(opening)
        last = np.append(runs[1:], len(at)) - 1
        owner = text[runs]
        places = begin[at[runs]] - begins[owner], end[at[last]] - begins[owner], row[at[last]], np.minimum.reduceat(scores, runs)
        for i, a, b, tag, score in zip(owner.tolist(), *(x.tolist() for x in places), strict=True):
            out[i].append((a, b, self.tags[tag][2:], score))
        return out

    def __call__(self, texts: list[str], labels: list[str], threshold: float) -> list[list[tuple[int, int, str, float]]]:
        wanted = set(labels)
        return [[s for s in own if s[2] in wanted and s[3] >= threshold] for own in self.spans_of(texts)]


def _in_steps(first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """For each word of several texts its place when all first words go first, then all second ones and so on, those of longer texts before others; and how many words each step has."""
    sizes = first[1:] - first[:-1]
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    active = (np.count_nonzero(sizes) - np.cumsum(np.bincount(sizes[sizes > 0]))[:-1]).tolist() if sizes.any() else []
    offset = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    return offset[np.arange(first[-1]) - np.repeat(first[:-1], sizes)] + np.repeat(rank, sizes), active


def _ways(steps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each first tag the second ones that can follow, and the logarithms of these steps."""
    return [(some, step[some, None]) for step in steps for some in [np.flatnonzero(step > -np.inf)]]


def _summed(logs: np.ndarray, ways: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logarithms of the sums over all first tags (rows of ``logs``), by second tag; what can't follow adds nothing."""
    out = np.full_like(logs, -np.inf)
    for one, (some, step) in zip(logs, ways, strict=True):
        out[some] = np.logaddexp(out[some], one + step)
    return out


def _moved(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The columns of a table whose row k goes to column ``place[k]``."""
    out = np.empty_like(rows)
    out[place] = rows
    return np.ascontiguousarray(out.T)


def count_features(labelled: DataFrame) -> DataFrame:
    """what (step, tag or feature), tag, value and n over the rows of ``labelled`` (text, spans of start, end and label)."""

    def count(texts: list[str], spans: list[tuple[int, int, int, str]], counts: Counter[tuple[str, str, str]]) -> None:
        begin, end, words, first, begins = words_of(texts)
        number: dict[str, int] = {}
        tag = tags_of(begin, end, first, [(k, a + begins[k], b + begins[k], label) for k, a, b, label in spans], number)
        tags = [*number, ""]

        def add(what: str, own: np.ndarray, values: list[str], kind: str = "") -> None:
            each, n = np.unique(tag * len(values) + own, return_counts=True)
            for t, v, k in zip((each // len(values)).tolist(), (each % len(values)).tolist(), n.tolist(), strict=True):
                counts[what, tags[t], kind + values[v]] += k

        before = np.concatenate([tag[:0], [len(number)], tag[:-1]])[: len(tag)]
        before[first[:-1][first[:-1] < first[1:]]] = len(number)
        add("step", before, tags)
        add("tag", np.zeros_like(tag), [""])
        for kind, (own, values) in numbered(words, first).items():
            add("feature", own, values, kind)

    def made(counts: Counter[tuple[str, str, str]]) -> pa.RecordBatch:
        what, tag, value = (pa.array([k[i] for k in counts], pa.string()) for i in range(3))
        return pa.RecordBatch.from_pydict({"what": what, "tag": tag, "value": value, "n": pa.array(counts.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str, str]] = Counter()
        for batch in batches:
            texts, column = [t or "" for t in batch["text"].to_pylist()], batch["spans"]
            owner = np.repeat(np.arange(len(texts)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = column.flatten()
            start, stop, label = (flat.field(flat.type.get_field_index(k)).to_pylist() for k in ("start", "end", "label")) if len(flat) else ([], [], [])
            for a, b in in_parts(texts):
                lo, hi = np.searchsorted(owner, [a, b])
                count(texts[a:b], list(zip((owner[lo:hi] - a).tolist(), start[lo:hi], stop[lo:hi], label[lo:hi], strict=True)), counts)
                if len(counts) > 1_000_000:  # a task's own sums stay bounded
                    yield made(counts)
                    counts = Counter()
        yield made(counts)

    schema = "what string, tag string, value string, n long"
    return labelled.select("text", "spans").mapInArrow(run, schema).groupBy("what", "tag", "value").agg(F.sum("n").alias("n"))


def train_tagger(labelled: DataFrame, most: int = FEATURES, smoothing: float = SMOOTHING) -> Tagger:
    """A tagger from all rows of ``labelled`` (text, spans: array of start, end and label).

    Null texts and rows without spans teach what stands outside. Of the features the
    ``most`` frequent ones are kept, ties by name; these, and counts of tags, are all that
    comes to the driver.
    """
    counted = count_features(labelled).groupBy("what", "value").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("by_tag"))
    # counts of tags, a row a tag, stand before the features
    first = counted.orderBy(F.col("what") == "feature", F.desc("total"), "value").limit(most + TAGS).collect()
    rows = [r for r in first if r.what == "feature"][:most]
    small = [(r.what, tag, r.value, n) for r in first if r.what != "feature" for tag, n in r.by_tag.items()]
    tags = sorted({tag for what, tag, *_ in small if what == "tag"} | {OUTSIDE})
    tags = sorted({*tags, *(f"I-{t[2:]}" for t in tags if t.startswith("B-"))})
    number = {t: k for k, t in enumerate(tags)}
    totals = np.zeros(len(tags))
    opens, steps = np.full(len(tags), smoothing), np.full((len(tags), len(tags)), smoothing)
    for what, tag, before, n in small:
        if what == "tag":
            totals[number[tag]] = n
        elif before:
            steps[number[before], number[tag]] += n
        else:
            opens[number[tag]] += n
    for t, k in number.items():
        if t.startswith("I-"):  # a further word only behind a word of its label
            opens[k] = 0
            for before, j in number.items():
                if before[2:] != t[2:]:
                    steps[j, k] = 0
    with np.errstate(divide="ignore"):
        opens, steps = np.log(opens / opens.sum()), np.log(steps / steps.sum(axis=1, keepdims=True))
    different = Counter(r.value[0] for r in rows)
    base = {kind: np.log(totals + smoothing * (different[kind] + 1)) for kind in KINDS}
    seen = {}
    for r in rows:
        n = np.full(len(tags), smoothing)
        for tag, k in r.by_tag.items():
            n[number[tag]] += k
        seen[r.value] = np.log(n) - base[r.value[0]]
    return Tagger(tags, opens, steps, seen, {kind: math.log(smoothing) - b for kind, b in base.items()})
