"""Quality rules: an ordered decision list, learned from labelled statistics and emitted as one Spark conditional expression.

Sequential covering: a rule is grown on two thirds of the labelled rows by adding the threshold condition with the best
FOIL gain, pruned on the last third, and kept if it is precise enough on both; the rows that it covers leave, and the next
rule is grown. A row is low where a rule fires; in the emitted list, earlier rules come first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import IS_WORD, Words, mix, released, text_chunks

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_bangs", "n_distinct_words")
STATS = "quality_stats"
FIT_ROWS = 20_000  # labelled rows that a list is fitted on: those with the smallest hashes of their ids


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS, BANGS, DIGITS = _table(b"#*$%&|<>"), _table(b"!"), _table(b"0123456789")
UPPER = _table(bytes(range(65, 91)))
LETTERS = UPPER | _table(bytes(range(97, 123)))


def counts_of(column):
    """For an Arrow column of whole texts: an integer array with a row of COUNTS for each text."""
    out = []
    factors = mix(np.arange(3, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    for _, _, data, ends in text_chunks(column):
        w, n = Words(data, ends, fold=False), len(ends)

        def total(mask, ends=ends):
            return np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(mask)])[ends]]))

        words = np.diff(w.first)
        doc = np.repeat(np.arange(n), words)
        m = max(len(doc) - 2, 0)
        windows = np.zeros(m, np.uint64)
        for j in range(3 if m else 0):
            windows += w.hashes[j : j + m] * factors[j]
        inside = doc[:m] == doc[2 : m + 2]
        keys = mix(windows + mix(doc[:m].astype(np.uint64)))[inside]
        _, back, often = np.unique(keys, return_inverse=True, return_counts=True)
        at = np.flatnonzero(inside)[often[back] > 1] if m else np.empty(0, np.int64)
        repeat = np.zeros(len(doc), bool)
        for j in range(3):
            repeat[at + j] = True
        own = mix(w.hashes + mix(doc.astype(np.uint64)))
        _, first = np.unique(own, return_index=True)
        begins = np.concatenate([[0], ends[:-1]])
        raw, lines, dups = data.tobytes(), [], []
        for a, b in zip(begins.tolist(), ends.tolist()):
            full = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            lines.append(len(full))
            dups.append(len(full) - len(set(full)))
        chars = IS_WORD[data] & ((data & 0xC0) != 0x80)
        out.append(np.stack([words, total(chars), total(SYMBOLS[data]), dups, np.bincount(doc[repeat], minlength=n), lines, total(UPPER[data]), total(LETTERS[data]), total(DIGITS[data]), total(BANGS[data]), np.bincount(doc[first], minlength=n)], axis=1))
    return np.concatenate(out).astype(np.int64) if out else np.empty((0, len(COUNTS)), np.int64)


def with_stats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) and a struct column `quality_stats` with COUNTS of the whole text (null: empty).

    A column of that name is replaced. Repeated rows have equal counts, an empty table gives no rows; very long texts are read whole.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != STATS]
    own = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"  # a text that is kept goes through the worker once
    rows = docs.select(*keep) if own else docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    at = keep.index(text_col) if own else len(keep)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts = counts_of(batch.column(at))
            stats = pa.StructArray.from_arrays([pa.array(counts[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], stats], names=[*keep, STATS])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(released(run), f"{fields}{', ' if fields else ''}{STATS} struct<{', '.join(f'{c}:bigint' for c in COUNTS)}>")


def measures(stats: str = STATS) -> dict[str, Column]:
    """What the rules compare with thresholds, as expressions over the struct of counts; per-cent figures are of their base."""
    c = {k: F.col(f"{stats}.{k}").cast("double") for k in COUNTS}
    per = lambda a, b: F.round(F.when(c[b] > 0, 100 * c[a] / c[b]).otherwise(0.0), 3)
    return {
        "n_words": c["n_words"],
        "word_length": F.round(F.when(c["n_words"] > 0, c["word_chars"] / c["n_words"]).otherwise(0.0), 3),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "upper": per("n_upper", "n_letters"),
        "digits": per("n_digits", "word_chars"),
        "bangs": per("n_bangs", "n_words"),
        "distinct": per("n_distinct_words", "n_words"),
    }


def base_failed(stats: str = STATS) -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


# ---------------------------------------------------------------- learning

@dataclass
class Rule:
    conditions: list[tuple[str, str, float]]  # measure, "<=" or ">=", threshold
    covered: int = 0
    right: int = 0

    def fires(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, value in self.conditions:
            out &= x[name] <= value if op == "<=" else x[name] >= value
        return out

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, value in self.conditions:
            out = out & (of[name] <= value if op == "<=" else of[name] >= value)
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def low(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            out |= rule.fires(x)
        return out

    def column(self, stats: str = STATS) -> Column:
        """The ordered conditional expression: the number, from 1, of the first rule that fires, or 0."""
        of, out = measures(stats), None
        for i, rule in enumerate(self.rules, 1):
            out = (F if out is None else out).when(rule.column(of), F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self):
        return "\n".join(f"{i}. low if " + " and ".join(f"{a} {o} {v:g}" for a, o, v in r.conditions) + f"  ({r.right} of {r.covered})" for i, r in enumerate(self.rules, 1))


def _grow(x, low, names, depth, cuts):
    on, conditions = np.ones(len(low), bool), []
    while len(conditions) < depth and (~low[on]).any():
        p0, n0 = low[on].sum(), (~low[on]).sum()
        best, gain = None, 0.0
        for name in names:
            v = x[name][on]
            values = np.unique(v)
            if len(values) > cuts:
                values = np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="nearest"))
            order = np.sort(v[low[on]]), np.sort(v[~low[on]])
            for op in ("<=", ">="):
                p, n = (np.searchsorted(o, values, side="right") if op == "<=" else len(o) - np.searchsorted(o, values, side="left") for o in order)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(g))
                if g[k] > gain + 1e-9:
                    best, gain = (name, op, float(values[k])), float(g[k])
        if best is None:
            break
        conditions.append(best)
        on &= x[best[0]] <= best[2] if best[1] == "<=" else x[best[0]] >= best[2]
    return conditions


def fit_list(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 7, most_rules: int = 12, depth: int = 4, cuts: int = 64, precision: float = 0.97, support: int = 3) -> DecisionList:
    """Learn a list from measures x and labels low (true: reject). A rule must cover `support` rows with `precision` on all labelled rows left."""
    out, names = DecisionList(), list(x)
    left = np.arange(len(low))
    part = mix(np.arange(len(low), dtype=np.uint64) + np.uint64(seed)) % np.uint64(3)
    while len(out.rules) < most_rules and low[left].any():
        grow, prune = left[part[left] > 0], left[part[left] == 0]
        at = lambda rows: {k: v[rows] for k, v in x.items()}
        if not low[grow].any():
            break
        conditions = _grow(at(grow), low[grow], names, depth, cuts)
        if not conditions:
            break

        def worth(conds, at=at, prune=prune):
            f = Rule(conds).fires(at(prune))
            p, n = (f & low[prune]).sum(), (f & ~low[prune]).sum()
            return (p - n) / (p + n) if p + n else 0.0

        sound = []
        for k in range(len(conditions), 0, -1):
            f = Rule(conditions[:k]).fires(at(left))
            covered, right = int(f.sum()), int(low[left][f].sum())
            if right >= support and right >= precision * covered:
                sound.append(Rule(conditions[:k], covered, right))
        if not sound:
            break
        out.rules.append(max(sound, key=lambda rule: worth(rule.conditions)))
        left = left[~out.rules[-1].fires(at(left))]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, **options) -> DecisionList:
    """Fit a list on at most `rows` labelled documents, those with the smallest hashes of their ids.

    Labels that are null, that belong to no document or contradict another label of their id are left out; without both
    kinds of label the list is empty and rejects nothing. Rows that fail the base limits teach nothing: the list judges the rest.
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__low"), F.max(label_col).alias("__high"))
    some = some.where("__low = __high").orderBy(F.xxhash64("__id"), "__id").limit(rows).select("__id", "__low")
    stats = with_stats(docs.join(F.broadcast(some), docs[id_col] == some["__id"]), text_col, ["__id", "__low"])  # `rows` rows at most
    got = stats.where(~base_failed()).select("__id", "__low", *[c.alias(k) for k, c in measures().items()]).orderBy(F.xxhash64("__id"), "__id", *measures()).limit(rows).collect()
    if not got:
        return DecisionList()
    x = {k: np.array([r[k] for r in got], float) for k in measures()}
    return fit_list(x, np.array([r["__low"] == 0 for r in got]), **options)


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of docs that neither the base limits nor a rule rejects, with their own columns."""
    judged = with_stats(docs, text_col)
    return judged.where(~base_failed() & (rules.column() == 0)).select(*[c for c in docs.columns if c != STATS])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = with_stats(docs.select("doc_id", "text"), keep=["doc_id"])
    cols = [F.col(f"{STATS}.{c}").alias(c) for c in COUNTS[:5]]
    return judged.select("doc_id", *cols, base_failed().alias("base_failed"), (~base_failed() & (rules.column() == 0)).alias("kept"), rules.column().alias("rule"))


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
