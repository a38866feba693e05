"""Image fingerprints of supplied pixels, and the search for visual copies of any picture: no faces, no persons."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import vectors as V
from auditlake.operators import pairs
from auditlake.operators.ordering import cap

CROP, LEAST, BANDS, MOST = 0.82, 0.80, 4, 12
FINGERPRINT = "id long, sha string, variants array<struct<p:long,d:long,a:long,c:array<double>>>"


def scaled(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, by the centres of pixels. (Devices' own scalers differ from each other in the last bits.)"""
    ys = np.clip((np.arange(h) + 0.5) * img.shape[0] / h - 0.5, 0, img.shape[0] - 1)
    xs = np.clip((np.arange(w) + 0.5) * img.shape[1] / w - 0.5, 0, img.shape[1] - 1)
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    return np.rint(top * (1 - fy) + (img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx) * fy)


def luma(img: np.ndarray) -> np.ndarray:
    return img @ np.array([0.299, 0.587, 0.114])


def _bits(flags: np.ndarray) -> int:
    """The first flag is the lowest bit."""
    return int(np.packbits(flags.ravel(), bitorder="little").view("<i8")[0])


def average_hash(img: np.ndarray) -> int:
    v = luma(scaled(img, 8, 8))
    return _bits(v >= v.mean())


def difference_hash(img: np.ndarray) -> int:
    v = luma(scaled(img, 9, 8))
    return _bits(v[:, :-1] >= v[:, 1:])


def perceptual_hash(img: np.ndarray) -> int:
    """Of the 8 by 8 lowest frequencies of a cosine transform, those at or above the median of all but the first, whose own bit is 0."""
    v = luma(scaled(img, 32, 32))
    basis = np.cos((2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 64)
    unit = np.where(np.arange(8) == 0, 1 / np.sqrt(2), 1.0)
    low = (0.25 * unit[:, None] * unit[None, :] * (basis @ v @ basis.T)).ravel()
    flags = low >= np.sort(low[1:])[63 // 2]
    flags[0] = False
    return _bits(flags)


def color_histogram(img: np.ndarray) -> list[float]:
    s = scaled(img, 64, 64).astype(int) // 64
    return (np.bincount((s[..., 0] * 16 + s[..., 1] * 4 + s[..., 2]).ravel(), minlength=64) / 4096).tolist()


def crops(img: np.ndarray) -> list[np.ndarray]:
    """The picture, its middle, and its middle square where it isn't one."""
    h, w = img.shape[:2]

    def middle(ch: int, cw: int) -> np.ndarray:
        return img[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw]

    out, small = [img], (max(1, int(h * CROP)), max(1, int(w * CROP)))
    if small != (h, w):
        out.append(middle(*small))
    if h != w:
        out.append(middle(min(h, w), min(h, w)))
    return out


def fingerprints(images: DataFrame) -> DataFrame:
    """(id, sha, variants) of pictures (id, width, height, pixels: red, green and blue bytes, row by row). Pixels of another number than width and height say have no variants."""
    import hashlib

    def run(batches):
        for b in batches:
            rows = []
            for i, w, h, px in zip(b["id"], b["width"], b["height"], b["pixels"]):
                v: list = []
                if px is not None and w > 0 and h > 0 and len(px) == w * h * 3:
                    img = np.frombuffer(px, np.uint8).reshape(h, w, 3).astype(float)
                    v = [{"p": perceptual_hash(x), "d": difference_hash(x), "a": average_hash(x), "c": color_histogram(x)} for x in crops(img)]
                rows.append((i, "" if px is None else hashlib.sha256(px).hexdigest(), v))
            yield pd.DataFrame(rows, columns=["id", "sha", "variants"])

    return images.select("id", "width", "height", "pixels").mapInPandas(run, FINGERPRINT)


def copies(queries: DataFrame, library: DataFrame, least: float = LEAST, most: int = MOST) -> DataFrame:
    """(query, id, score, class): for each query fingerprint (query, sha, variants) the library's best ones of at least that score, compared variant by variant; equal scores go by id.

    Every query meets every row, block by block. Hashes give a score that none exceeds, in whole numbers; only pairs that by it may be among a query's best of the block are scored in full, and only its best leave the task.
    """
    library = library.select("id", "sha", "variants")
    blocks = pairs.beside(queries.select(F.col("query").alias("id"), "sha", "variants"), library, _packed)

    def run(batches):
        for b in batches:
            for x in b.to_dict("records"):
                for query, id_, score, exact in _best(pickle.loads(x["q"]), pickle.loads(x["r"]), least, most):
                    yield pd.DataFrame({"query": query, "id": id_, "score": score, "exact": exact})

    d = blocks.mapInPandas(run, "query long, id long, score double, exact boolean")
    return cap(d.select("query", "id", "score", V.duplicate_class(F.col("score"), F.col("exact")).alias("class")), ["query"], [F.desc("score"), "id"], most)


def _packed(d: DataFrame, p: str) -> DataFrame:
    """Blocks of fingerprints: ids, hashes of the bytes, and of each variant three hashes and the histogram, with how many variants there are."""

    def block(b: pd.DataFrame) -> pd.DataFrame:
        count = np.array([0 if v is None else len(v) for v in b["p"]])
        most, bins = max(1, count.max()), max((len(c) for v in b["c"] if v is not None for c in v if c is not None), default=0)
        hashes, c = np.zeros((3, len(b), most), np.uint64), np.full((len(b), most, bins), np.nan)
        for i, n in enumerate(count):
            if n:
                for k, name in enumerate("pda"):
                    hashes[k, i, :n] = np.asarray(b[name].iloc[i], np.int64).view(np.uint64)
                for v, h in enumerate(b["c"].iloc[i]):
                    if h is not None:
                        c[i, v, : len(h)] = np.asarray(h, float)
        return pd.DataFrame({p: [pickle.dumps((b["id"].to_numpy(np.int64), b["sha"].tolist(), count, hashes, c))]})

    def run(batches):
        yield from map(block, pairs.chunks(batches))

    of = lambda k: F.transform("variants", lambda v: v[k]).alias(k)
    return d.select("id", "sha", *[of(k) for k in "pdac"]).mapInPandas(run, f"{p} binary")


def _scores(q: tuple, r: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """V.image_similarity of the pairs, without equal bytes, in the same order of additions."""
    (_, _, qn, qh, qc), (_, _, rn, rh, rc) = q, r
    parts = [(1 - np.arange(65) / 64.0) * V.WEIGHTS[k] for k in "pda"]
    out = np.zeros(len(i))
    for x in range(qh.shape[2]):
        for y in range(rh.shape[2]):
            s = sum((part[np.bitwise_count(qh[k, i, x] ^ rh[k, j, y])] for k, part in list(enumerate(parts))[1:]), parts[0][np.bitwise_count(qh[0, i, x] ^ rh[0, j, y])])
            common = np.zeros(len(i))
            for b in range(min(qc.shape[2], rc.shape[2])):
                least = np.minimum(qc[i, x, b], rc[j, y, b])
                common += np.where(np.isnan(least), 0.0, least)
            s = np.clip(s + np.clip(common, 0.0, 1.0) * V.WEIGHTS["c"], 0.0, 1.0)
            out = np.where((x < qn[i]) & (y < rn[j]), np.maximum(out, s), out)
    return out


def _best(q: tuple, r: tuple, least: float, most: int):
    """(query, id, score, exact) of the best pairs of two blocks."""
    (qid, qsha, qn, qh, _), (rid, rsha, rn, rh, _) = q, r
    weight, m = [round(V.WEIGHTS[k] * 100) for k in "pda"], len(rid)
    code = {s: k for k, s in enumerate(dict.fromkeys(s for s in qsha if s))}
    qcode, rcode = np.array([code.get(s, -1) for s in qsha]), np.array([code.get(s, -2) for s in rsha])
    oi, oj = pairs.own_places(qid, rid)
    for a in range(0, len(qid), pairs.STRIPE):
        b = min(a + pairs.STRIPE, len(qid))
        far = np.full((b - a, m), 6400, np.int16)  # in 6400ths below 1, at least: the histogram adds its whole share at most
        for x in range(qh.shape[2]):
            for y in range(rh.shape[2]):
                w = np.zeros((b - a, m), np.int16)
                for k in range(3):
                    w += np.bitwise_count(qh[k, a:b, x, None] ^ rh[k, None, :, y]) * np.int16(weight[k])
                w[qn[a:b] <= x] = 6400
                w[:, rn <= y] = 6400
                np.minimum(far, w, out=far)
        same = qcode[a:b, None] == rcode[None, :]
        far[same] = 0
        mine = (oi >= a) & (oi < b)
        far[oi[mine] - a, oj[mine]] = 32767
        near = np.partition(far, most - 1, axis=1)[:, most - 1] if m > most else np.full(b - a, 6400, np.int16)
        last = int(np.floor((1 - least + 1e-9) * 6400))
        first = (far <= near[:, None]) & (far <= min(last, 6400))
        found = _top(q, r, a, same, first, least, most)
        # what is farther may still be better, where histograms took much from those scored so far
        n = np.bincount(found[0], minlength=b - a)
        worst = np.full(b - a, least)
        np.minimum.at(full := np.full(b - a, 2.0), found[0], found[2])
        worst = np.where(n >= most, np.maximum(worst, full), worst)
        more = (far > near[:, None]) & (far <= np.minimum(np.floor((1 - worst + 1e-9) * 6400), 6400)[:, None])
        if more.any():
            found = _top(q, r, a, same, more | first, least, most)
        i, j, s, exact = found
        yield qid[a + i], rid[j], s, exact


def _top(q: tuple, r: tuple, a: int, same: np.ndarray, some: np.ndarray, least: float, most: int) -> tuple:
    i, j = np.nonzero(some)
    exact = same[i, j]
    s = np.where(exact, 1.0, _scores(q, r, i + a, j))
    order = np.lexsort((r[0][j], -s, i))
    order = order[s[order] >= least]
    i, j, s, exact = i[order], j[order], s[order], exact[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < most
    return i[keep], j[keep], s[keep], exact[keep]


def prominent(objects: DataFrame, key: str = "image", least_score: float = 0.82, area_ratio: float = 0.58, score_delta: float = 0.08) -> DataFrame:
    """(key, object, verdict): the most prominent object (key, object, area, score) of a picture by area times score; `ambiguous` where the next is nearly as large and as sure, `none` where there is none."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(F.desc(F.col("area") * F.col("score")), "object")
    good = objects.where((F.col("area") > 0) & (F.col("score") >= least_score))
    d = good.withColumns({"rank": F.row_number().over(w), "a2": F.lead("area").over(w), "s2": F.lead("score").over(w)}).where("rank = 1")
    close = F.coalesce((F.col("a2") >= F.col("area") * area_ratio) & (F.col("s2") >= F.col("score") - score_delta), F.lit(False))
    all_ = objects.select(key).distinct().join(d, key, "left")
    return all_.select(key, F.when(~close, F.col("object")).alias("object"), F.when(F.col("rank").isNull(), "none").when(close, "ambiguous").otherwise("selected").alias("verdict"))
