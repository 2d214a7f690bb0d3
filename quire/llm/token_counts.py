"""Token counts of a document's sections, from one encoding of the whole document.

Tokens carry their code point spans in the text; a sorted interval join gives each token its section. A token that
crosses a boundary goes by an explicit rule: `start` (the section of its first character), `most` (the section that has
most of its characters, the first of equals) or `share` (to each its part of the characters, as fractions).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import released

from .codec import codec, texts_of

TOKENIZER = "byte_bpe_50k.json"
RULES = ("start", "most", "share")


def lines_of(text: str) -> np.ndarray:
    """The spans of a text's lines, each with its line feed; an empty text has one empty line."""
    sizes = np.fromiter((len(x) for x in text.split("\n")), np.int64) + 1
    ends = np.cumsum(sizes)
    ends[-1] -= 1
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str):
    """(tokens of each section as floats, number of tokens that cross a boundary, tokens outside all sections).

    spans: tokens by start; sections: disjoint half-open spans by start. Tokens of no width count at their start. With
    rule `share`, the characters of a token that lie in no section give nothing.
    """
    out, m = np.zeros(len(sections)), len(sections)
    if not m or not len(spans):
        return out, 0, len(spans)
    a, b = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    left = np.searchsorted(sections[:, 1], a, side="right")  # the first section that ends after the start
    right = np.searchsorted(sections[:, 0], b, side="left")  # one past the last that begins before the end
    n = np.maximum(right - left, 0)
    inside = n == 1
    whole = inside & (sections[np.minimum(left, m - 1), 0] <= a) & (sections[np.minimum(left, m - 1), 1] >= b)
    np.add.at(out, left[whole], 1.0)
    outside = 0
    for k in np.flatnonzero(~whole):  # few: only tokens at boundaries
        span = range(left[k], left[k] + n[k])
        parts = [min(b[k], sections[s, 1]) - max(a[k], sections[s, 0]) for s in span]
        if not parts:
            outside += 1
        elif rule == "share":
            for s, p in zip(span, parts):
                out[s] += p / (b[k] - a[k])
        elif rule == "most":
            out[span[int(np.argmax(parts))]] += 1
        elif sections[left[k], 0] <= a[k]:
            out[left[k]] += 1
        else:
            outside += 1
    return out, int((n > 1).sum()), outside


def _count(tokenizer: str, rule: str, given: bool):
    def run(batches):
        import pyarrow as pa

        coder = codec(tokenizer, offsets=True)
        for batch in batches:
            for at, texts in texts_of(batch.column(1)):
                _, counts, spans = coder.encode(texts)
                ends = np.cumsum(counts)
                rows = []
                for k, text in enumerate(texts):
                    own = spans[ends[k] - counts[k] : ends[k]]
                    if given:
                        listed = [(s["start"], s["end"]) for s in batch.column(2)[at + k].as_py() or [] if s and s["start"] is not None and s["end"] is not None]
                        sections = np.array(sorted(listed), np.int64).reshape(-1, 2)
                    else:
                        sections = lines_of(text)
                    got, crossing, outside = attribute(own, sections, rule)
                    rows.append((int(counts[k]), len(sections), crossing, outside, got.tolist()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens"])

    return run


def token_counts(docs: DataFrame, sections_col: str | None = None, rule: str = "start", tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, n_outside, section_tokens) for every row.

    sections_col: an array of structs (start, end), disjoint code point spans; by default the sections are the text's
    lines. Null texts count as empty: no tokens, one empty line. Null sections are skipped. Repeated rows are rows of
    their own, an empty table gives no rows, other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if sections_col:
        cols.append(F.transform(F.col(sections_col), lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("sections"))
    return docs.select(*cols).mapInArrow(released(_count(tokenizer, rule, bool(sections_col))), "doc_id long, n_tokens long, n_sections long, n_crossing long, n_outside long, section_tokens array<double>")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every whole text, a boundary-crossing token by its first character."""
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("section_tokens", F.transform("section_tokens", lambda x: x.cast("long")))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
