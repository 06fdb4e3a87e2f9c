"""Languages by the frequency of groups of three characters, learned from labelled rows and scored over whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 3
#: Groups that a model keeps, by how often they occur; what is added to each count.
GROUPS, SMOOTHING = 200_000, 0.5
#: Characters that are counted at once, and different groups that a task keeps before it passes its sums on.
AT_ONCE, KEPT = 1 << 22, 1 << 20


def codes(text: str) -> np.ndarray:
    """All groups of three characters of a text as numbers, 21 bits a character, in the order of code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def groups(numbers: np.ndarray) -> list[str]:
    """The groups that ``numbers`` stand for."""
    points = np.stack([numbers >> 42, numbers >> 21 & 0x1FFFFF, numbers & 0x1FFFFF], axis=1).astype("<u4")
    whole = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[k : k + N] for k in range(0, len(whole), N)]


@dataclass(frozen=True)
class Languages:
    """A trained model: ``keys`` are its groups' numbers, ascending, ``seen`` the logarithms of their shares by language, ``unseen`` that of groups it doesn't have."""

    names: tuple[str, ...]
    keys: np.ndarray
    seen: np.ndarray
    unseen: np.ndarray

    def guess(self, text: str | None) -> str | None:
        """The language in which the whole text is most probable, the first by name of equal ones; null texts have none."""
        if text is None:
            return None
        padded, total = f" {text.lower()} ", np.zeros(len(self.names))
        for k in range(0, len(padded), AT_ONCE):
            own = codes(padded[k : k + AT_ONCE + N - 1])
            at = np.searchsorted(self.keys, own)
            found = at[at < len(self.keys)]
            found = found[self.keys[found] == own[at < len(self.keys)]]
            total = total + self.seen[found].sum(axis=0) + (len(own) - len(found)) * self.unseen
        return self.names[int(np.argmax(np.round(total, 6)))]

    def column(self, text: Column) -> Column:
        """The guess as a column."""
        guess = self.guess

        @F.pandas_udf("string")
        def of(texts: pd.Series) -> pd.Series:
            return texts.map(guess)

        return of(text)


def group_counts(labelled: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """language, group and n over all rows; tasks add up their own rows first, in time linear in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, pd.Series] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def add(name: str) -> None:
            new = pd.Series(np.concatenate(waiting.pop(name))).value_counts(sort=False)
            sums[name] = sums[name].add(new, fill_value=0) if name in sums else new

        def drain() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                yield pa.RecordBatch.from_pydict({"language": pa.array([name] * len(n), pa.string()), "group": pa.array(groups(n.index.to_numpy()), pa.string()), "n": pa.array(n.to_numpy().astype(np.int64))})
            sums.clear()

        held: dict[str, int] = {}
        for batch in batches:
            for name, whole in zip(batch["language"].to_pylist(), batch["t"], strict=True):
                padded = whole.as_py()
                for k in range(0, len(padded), AT_ONCE):
                    own = codes(padded[k : k + AT_ONCE + N - 1])
                    waiting.setdefault(name, []).append(own)
                    held[name] = held.get(name, 0) + len(own)
                    if held[name] > AT_ONCE:
                        add(name)
                        held[name] = 0
                        if sum(map(len, sums.values())) > KEPT:
                            yield from drain()
        for name in list(waiting):
            add(name)
        yield from drain()

    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    own = labelled.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(language).alias("language"), padded.alias("t"))
    counted = own.mapInArrow(run, "language string, group string, n long")
    return counted.groupBy("language", "group").agg(F.sum("n").alias("n"))


def train_languages(labelled: DataFrame, text: str = "text", language: str = "lang", most: int = GROUPS, smoothing: float = SMOOTHING) -> Languages:
    """A model of all rows of ``labelled``; the ``most`` frequent groups come to the driver, ties by name."""
    counts = group_counts(labelled, text, language).persist()
    try:
        totals = {r.language: r.n for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
        rows = counts.groupBy("group").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("by")).orderBy(F.desc("total"), "group").limit(most).collect()
    finally:
        counts.unpersist()
    names = tuple(sorted(totals))
    base = np.log([totals[x] + smoothing * (len(rows) + 1) for x in names])
    keys = codes("".join(r.group for r in rows))[::N] if rows else np.zeros(0, np.int64)
    seen = np.log(np.array([[r.by.get(x, 0) + smoothing for x in names] for r in rows]).reshape(len(rows), len(names))) - base
    order = np.argsort(keys)
    return Languages(names, keys[order], seen[order], np.log(smoothing) - base)
