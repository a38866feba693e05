"""Operator 6: SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant texts.

A sequence of pieces is what the model's merges make of a text exactly if every piece is made from its own
characters and every two neighbours from theirs. So the encoding is the one path of finite weight in a graph
whose states are pieces placed on the text, and a chunk of text is a matrix over the pieces across its borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import cut, tidy

MODEL, CHUNK = "/opt/tokenizers/piece_bpe_32k.model", 32_768
BLANK = "▁"
UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
NEVER = -np.inf


class PieceCoder:
    """Encoder and decoder of one model file; caches are bounded."""

    def __init__(self, model: str = MODEL, bound: int = 60_000):
        import sentencepiece

        self.sp, self.bound, self.known = sentencepiece.SentencePieceProcessor(model_file=model), bound, {}
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        self.id = {p: i for i, p in enumerate(names) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))}
        self.score = {p: self.sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id), default=1)
        value = {i: b for b, i in self.byte.items()}
        self.bytes = [bytes([value[i]]) if i in value else b"" if self.sp.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece of this model holds a blank after another character")
        self.made: dict[str, bool] = {}
        self.pair: dict[tuple[str, str], bool] = {}

    def _unit(self, unit: str) -> bytes:
        """The ids of a blank-led unit, without its first blank, which the model adds itself, but not to an empty one: the blank that ends a text."""
        return np.array(self.sp.encode(unit) if unit else self.piece_ids(BLANK), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. No piece has a blank after another character, so the units between such places are encoded apart, and known ones looked up."""
        if not text:
            return np.zeros(0, np.int32)
        units = text.split(" ") if BLANK not in text else [""]
        if "" in units:
            units = [u[1:].replace(BLANK, " ") for u in UNITS.findall(BLANK + text.replace(" ", BLANK))]
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for u in set(units).difference(known):
            known[u] = self._unit(u)
        return np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32)

    def encode_whole(self, text: str, chunk: int = CHUNK) -> np.ndarray:
        """The same ids without looking units up: where most units are new, one call for a text costs less. Long texts go in parts of about `chunk` characters, cut at blanks that no piece crosses."""
        parts, at = [], 0
        while len(text) - at > chunk:
            to = text.find(" ", at + chunk)
            while to > 0 and text[to - 1] in f" {BLANK}":
                to = text.find(" ", to + 1)
            if to < 0 or to + 1 == len(text):
                break
            parts.append(self.sp.encode(text[at:to], out_type="numpy"))
            at = to + 1  # the model adds this blank itself
        parts.append(self.sp.encode(text[at:], out_type="numpy"))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids) -> str:
        """The text of ids: pieces' characters, bytes joined, without the blank that encoding put first."""
        out = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    # the graph of a chunk

    def merges(self, s: str) -> list[str]:
        """What the model's merges make of a short string: the best-scored neighbours become one, the left one first."""
        parts = list(s)
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                v = self.score.get(parts[i] + parts[i + 1], NEVER)
                if v > best:
                    best, at = v, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, p: str) -> bool:
        if len(self.made) > 100_000:
            self.made.clear()
        if p not in self.made:
            self.made[p] = len(p) == 1 or (p in self.id and self.merges(p) == [p])
        return self.made[p]

    def fits(self, a: str, b: str) -> bool:
        if b[0] == BLANK and a[-1] != BLANK:
            return True
        if len(self.pair) > 50_000:
            self.pair.clear()
        k = (a, b)
        if k not in self.pair:
            self.pair[k] = self.merges(a + b) == [a, b]
        return self.pair[k]

    def weight(self, p: str) -> float:
        return self.score.get(p, 0.0)

    def piece_ids(self, p: str) -> list[int]:
        return [self.id[p]] if p in self.id else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")] if self.byte else [self.sp.unk_id()]

    def across(self, s: str, at: int) -> list[tuple[int, int]]:
        """Border states: (start, end) of the pieces that start before `at` and end there or later."""
        return [(x, y) for x in range(max(0, at - self.longest), at) for y in range(at, min(len(s), x + self.longest) + 1) if self.alone(s[x:y])]

    def paths(self, s: str, entry: list[tuple[int, int]], end: int) -> tuple[dict, list[tuple[int, int]]]:
        """Best weights from each entry state to each border state at `end`: {(x, y): (weight by entry, state before by entry)} of all states on the way."""
        table: dict[tuple[int, int], tuple[np.ndarray, list]] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, st in enumerate(entry):
            w = np.full(len(entry), NEVER)
            w[k] = 0.0
            table[st] = (w, [None] * len(entry))
            ends.setdefault(st[1], []).append(st)
        final = [st for st in entry if st[1] >= end]
        for x in range(min(ends, default=end), end):
            before = ends.pop(x, ())
            if not before:
                continue
            for y in range(x + 1, min(len(s), x + self.longest) + 1):
                p = s[x:y]
                if not self.alone(p):
                    continue
                best, back = np.full(len(entry), NEVER), [None] * len(entry)
                for st in before:
                    if st[1] == st[0] or self.fits(s[st[0] : st[1]], p):
                        w = table[st][0]
                        for k in np.nonzero(w + self.weight(p) > best)[0]:
                            best[k], back[k] = w[k] + self.weight(p), st
                if (best > NEVER).any():
                    table[(x, y)] = (best, back)
                    ends.setdefault(y, []).append((x, y))
                    if y >= end:
                        final.append((x, y))
        return table, final

    def _syncs(self, s: str, lo: int, hi: int) -> tuple[int, int]:
        """First and last place in [lo, hi] where no piece can cross, or (-1, -1)."""
        places = [lo + m.end() - 1 for m in re.finditer(f"[^{BLANK}]{BLANK}", s[lo:hi])] if hi - lo > 1 else []
        return (places[0], places[-1]) if places else (-1, -1)

    def matrix(self, s: str, lo: int, hi: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
        """(entry states, exit states, max-plus matrix) of the chunk s[lo:hi] with its surroundings."""
        entry = [(lo, lo)] if first else self.across(s, lo)
        a, b = self._syncs(s, lo, hi)
        if a < 0:
            table, final = self.paths(s, entry, hi)
            out = [st for st in final if not last or st[1] == hi]
            m = np.array([table[st][0] for st in out]).reshape(len(out), len(entry)).T
            return entry, out, m
        table, final = self.paths(s, entry, a)
        head = np.array([table[st][0] for st in final if st[1] == a]).reshape(-1, len(entry))
        start = head.max(axis=0, initial=NEVER)
        middle = self._weight(s[a:b])
        tail, final = self.paths(s, [(b, b)], hi)
        out = [st for st in final if not last or st[1] == hi]
        end = np.array([tail[st][0][0] for st in out])
        return entry, out, start[:, None] + middle + end[None, :]

    def _weight(self, s: str) -> float:
        return float(sum(self.sp.get_score(int(i)) for i in self.encode(s[1:].replace(BLANK, " ")))) if s else 0.0

    def trace(self, s: str, lo: int, hi: int, entry: tuple[int, int], leave: tuple[int, int]) -> np.ndarray:
        """Ids of the pieces that start in s[lo:hi], on the path from the entry state to the exit state."""

        def back(table, st, stop):
            ids = []
            while st != stop:
                ids.append(self.piece_ids(s[st[0] : st[1]]))
                st = table[st][1][0]
            return [i for part in reversed(ids) for i in part]

        a, b = self._syncs(s, lo, hi)
        if a < 0:
            return np.array(back(self.paths(s, [entry], hi)[0], leave, entry), np.int32)
        table, final = self.paths(s, [entry], a)
        st = next(x for x in final if x[1] == a and table[x][0][0] > NEVER)
        head = back(table, st, entry)
        tail = back(self.paths(s, [(b, b)], hi)[0], leave, (b, b))
        return np.concatenate([np.array(head, np.int32), self.encode(s[a + 1 : b].replace(BLANK, " ")) if b > a else np.zeros(0, np.int32), np.array(tail, np.int32)])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(ms: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by halves."""
    if len(ms) < 2:
        return list(ms)
    pairs = scan([times(ms[i], ms[i + 1]) for i in range(0, len(ms) - 1, 2)])
    return [ms[0] if i == 0 else pairs[i // 2] if i % 2 else times(pairs[i // 2 - 1], ms[i]) for i in range(len(ms))]


def _ids_column(ids: list) -> pa.Array:
    """list<int32> out of numpy arrays, null for None, without Python integers."""
    lengths = np.array([0 if x is None else len(x) for x in ids], np.int32)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.concatenate([x for x in ids if x is not None and len(x)] or [np.zeros(0, np.int32)])
    mask = np.array([x is None for x in ids], bool)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array(mask) if mask.any() else None)


_RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])


def encode_documents(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_ids, ids, exact) for every row: the ids of its whole text, and whether they decode to it again.

    Texts longer than `chunk` are cut into chunks. One pass makes a max-plus matrix of each; the matrices
    of a text are combined by an associative scan, which gives each border's piece; then chunks are traced back independently
    and put together. The ids are those of the model's own encoder. A null text has null ids; an empty one has none
    and is exact; U+2581 decodes to a blank. Repeated rows, and rows without doc_id, give a row each. Other columns
    are never read. An empty table gives an empty result.
    """
    chunk = max(chunk, 64)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_ = F.coalesce(F.length("text"), F.lit(0)) > chunk

    def short(batches):
        coder = PieceCoder(model)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else coder.encode(t) for t in texts]
                exact = [None if t is None else coder.decode(x.tolist()) == t for t, x in zip(texts, ids)]
                n = pa.array([None if x is None else len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, _ids_column(ids), pa.array(exact, pa.bool_())], ["doc_id", "n_ids", "ids", "exact"])

    return d.where(~long_).mapInArrow(tidy(short), _RESULT).unionByName(_giants(d.where(long_), model, chunk))


def _giants(d: DataFrame, model: str, chunk: int) -> DataFrame:
    reach = 64  # more than any piece is long

    def chunks(batches):
        """Each text's chunks with what is around them, cut out in one pass."""
        for b in batches:
            for rid, doc, none, text in zip(b["rid"], b["doc_id"], b["none"], b["text"]):
                s = BLANK + text.replace(" ", BLANK)
                n, rows = len(s), []
                for k, lo in enumerate(range(0, n, chunk)):
                    start, hi = max(lo - reach, 0), min(lo + chunk, n)
                    rows.append((rid, None if none else doc, k, s[start : lo + chunk + reach], lo - start, hi - start, lo + chunk >= n, start))
                    if len(rows) >= 64:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["rid", "doc_id", "k", "s", "lo", "hi", "last", "at"]).astype({"doc_id": "Int64"})

    numbered = d.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    parts = cut(numbered.mapInPandas(tidy(chunks), "rid long, doc_id long, k int, s string, lo int, hi int, last boolean, at int"))

    def key(states, at):
        return [f"{x + at}:{y + at}" for x, y in states]

    def matrices(batches):
        coder = PieceCoder(model)
        for b in batches:
            out = []
            for r in b.itertuples():
                i, j, m = coder.matrix(r.s, r.lo, r.hi, r.k == 0, r.last)
                out.append((r.rid, r.k, key(i, r.at), key(j, r.at), m.ravel().tolist()))
            yield pd.DataFrame(out, columns=["rid", "k", "i", "j", "m"])

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        """The border piece before and after each chunk: the prefix product's best state that the rest can continue from."""
        pdf = pdf.sort_values("k")
        i, j = [list(x) for x in pdf.i], [list(x) for x in pdf.j]
        ms = [np.array(m, float).reshape(len(a), len(b)) for m, a, b in zip(pdf.m, i, j)]
        for q in range(len(ms) - 1):  # the next chunk lists the same states, in its own order
            ms[q] = ms[q][:, [j[q].index(x) for x in i[q + 1]]] if set(i[q + 1]) <= set(j[q]) else np.stack([ms[q][:, j[q].index(x)] if x in j[q] else np.full(len(i[q]), NEVER) for x in i[q + 1]], 1)
            j[q] = i[q + 1]
        before = [p.max(axis=0) for p in scan(ms)]
        after = [p.max(axis=0) for p in scan([m.T for m in ms[::-1]])][::-1]
        ends = [j[q][int(np.argmax(before[q] + (after[q + 1] if q + 1 < len(ms) else 0)))] for q in range(len(ms))]
        return pd.DataFrame({"rid": pdf.rid, "k": pdf.k, "entry": [i[0][0], *ends[:-1]], "leave": ends})

    found = parts.mapInPandas(tidy(matrices), "rid long, k int, i array<string>, j array<string>, m array<double>")
    states = cut(found.groupBy("rid").applyInPandas(borders, "rid long, k int, entry string, leave string"))

    def traced(batches):
        coder = PieceCoder(model)
        for b in batches:
            for r in b.itertuples():
                entry, leave = (tuple(int(v) - r.at for v in x.split(":")) for x in (r.entry, r.leave))
                # a row at a time: a chunk's ids and text are large
                yield pd.DataFrame([(r.rid, None if pd.isna(r.doc_id) else r.doc_id, r.k, coder.trace(r.s, r.lo, r.hi, entry, leave), r.s[r.lo : r.hi])], columns=["rid", "doc_id", "k", "ids", "s"]).astype({"doc_id": "Int64"})

    done = parts.join(states, ["rid", "k"]).mapInPandas(tidy(traced), "rid long, doc_id long, k int, ids array<int>, s string")
    whole = done.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids", "s"))).alias("parts"))
    joined = whole.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("s"))
    return joined.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (decode_column(model)("ids") == F.replace(F.expr("substring(s, 2)"), F.lit(BLANK), F.lit(" "))).alias("exact"))


def decode_column(model: str = MODEL):
    """A column function from ids to text; null for null, and empty for no ids."""

    def each(batches):
        coder = PieceCoder(model)
        for ids in batches:
            yield pd.Series([None if x is None else coder.decode(np.asarray(x).tolist()) for x in ids], dtype=object)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(each)(batches)

    return decode
