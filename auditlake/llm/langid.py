"""Operator 8: language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import per_doc

PER_LANGUAGE, DICTIONARY, LEVEL, MARGIN, CHUNK = 150, 32_768, 6, 0.01, 65_536


def dictionaries(docs: DataFrame, per_language: int = PER_LANGUAGE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw content for each language: at most `per_language` labelled texts, those of least hash, and `size` bytes in equal shares, of which long texts also get what short ones leave: the documented bound of labelled rows."""
    from pyspark.sql import Window as W

    known = docs.where("lang is not null and lang != '' and text is not null and length(text) > 0 and doc_id is not null")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id", "lang", "r")
    rows = known.select("doc_id", "lang", F.substring("text", 1, size).alias("text")).join(F.broadcast(ids), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"]).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.r)):
        by.setdefault(r.lang, []).append(folded(r.text))

    def content(texts: dict[str, list]) -> dict[str, bytes]:
        return {k: b"\n".join(shares(v, size)) for k, v in texts.items() if v}

    # labels can be wrong: each half of the sample is read by the other's dictionaries, and a text goes that is nearer to another language
    halves = [{k: v[i::2] for k, v in by.items()} for i in (0, 1)]
    readers = [Classifier(content(h)) for h in halves]
    kept = {k: [t for i in (0, 1) for t in halves[i][k] if readers[1 - i].nearest(t) in (k, None)] or v for k, v in by.items()}
    return content(kept)


def shares(texts: list[bytes], size: int) -> list[bytes]:
    """The texts' first bytes, `size` in all with a separator between two: as many of each, and what short ones leave to the others."""
    left, most = max(0, size - len(texts) + 1), {}
    for n, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        most[i] = min(len(texts[i]), left // (len(texts) - n))
        left -= most[i]
    return [t[: most[i]] for i, t in enumerate(texts)]


def folded(text: str) -> bytes:
    """The bytes of a text in lower case."""
    return text.lower().encode("utf-8", "surrogatepass")


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN):
        import zstandard

        self.langs, self.margin, self.coders = sorted(content), margin, []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(content[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> list[int]:
        """Compressed size by language; a long text is the sum of its chunks, all of them."""
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]

    def nearest(self, raw: bytes) -> str | None:
        sizes = self.sizes(raw)
        return self.langs[int(np.argmin(sizes))] if sizes else None

    def __call__(self, text: str | None) -> tuple[str | None, str | None, float | None]:
        """(language or None where rejected, nearest language, margin)."""
        if not text or not self.langs:
            return None, None, None
        sizes = self.sizes(folded(text))
        order = np.argsort(sizes, kind="stable")
        best = int(order[0])
        margin = 1.0 if len(order) < 2 else (sizes[order[1]] - sizes[best]) / sizes[order[1]]
        return self.langs[best] if margin >= self.margin else None, self.langs[best], float(margin)


def identify(docs: DataFrame, content: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """(doc_id, language, nearest, margin) of every row: the language whose dictionary compresses the whole text best.

    margin is by how much the second-best size is larger, as a part of it; below the limit, language is null and
    nearest still names the best; of equal sizes, the first by name. Null and empty texts, or no dictionary, give nulls. Repeated rows,
    and rows without doc_id, give a row each. Only doc_id and text are read here. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        c = Classifier(shared.value, level, margin)
        for b in batches:
            rows = [c(t) for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "language": [r[0] for r in rows], "nearest": [r[1] for r in rows], "margin": pd.array([r[2] for r in rows], "Float64")})

    return per_doc(docs, run, "doc_id long, language string, nearest string, margin double", "doc_id", "text")


def languages(docs: DataFrame, **options) -> DataFrame:
    """identify() of all documents by dictionaries of a bounded number of labelled ones (column lang)."""
    return identify(docs, dictionaries(docs), **options)
