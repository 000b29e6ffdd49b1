"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram binds its letters' vectors, each rolled
by its place, into one vector by multiplication; a text bundles its n-grams by addition. A language's
prototype bundles its training texts, each brought to the same length first, and a text gets the
language of the nearest prototype by cosine.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score 0, as are
all texts when nothing could be learned; ties go to the language first in alphabetical order; a null
doc_id is never trained on and not held out; extra columns of the input stay out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UND = "und"
SCALE = 1 << 20  # prototypes are summed as whole numbers, so that the order of tasks doesn't matter


class Encoder:
    """Texts -> bundled n-gram vectors, many texts at a time."""

    CHUNK = 400_000  # letters whose n-grams are counted at once

    def __init__(self, dims: int, n: int, seed: int):
        self.dims, self.n, self.seed = dims, n, seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def chunks(self, texts: list[str | None]):
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= self.CHUNK:
                yield texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield texts[at:]

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, all zero where there is no letter."""
        n, gap = self.n, ord(" ")
        low = [f"{' ' * n}{(t or '').lower()}{' ' * n}" for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(low), dtype=np.int32), np.fromiter(map(len, low), dtype=np.int64, count=len(low)))
        seen = np.flatnonzero(np.bincount(codes))
        kind = np.zeros(int(seen[-1]) + 1, dtype=np.int32)
        alphabet = [gap, *(c for c in seen.tolist() if chr(c).isalpha())]
        kind[alphabet] = np.arange(len(alphabet))
        k = kind[codes]
        keep = np.ones(len(k), dtype=bool)
        keep[1:] = (k[1:] != 0) | (k[:-1] != 0) | (owner[1:] != owner[:-1])  # one gap between words, and before each text, whatever stands there
        k, owner = k[keep].astype(np.int64), owner[keep]
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        m = len(k) - n + 1
        if m <= 0 or len(alphabet) == 1:
            return out
        gram = np.zeros(m, dtype=np.int64)
        for i in range(n):
            gram = gram * len(alphabet) + k[i : m + i]
        inner = (owner[:m] == owner[n - 1 :]) & (gram != 0)
        gram, owner = gram[inner], owner[:m][inner]
        room = len(alphabet) ** n
        if room <= 4_000_000:
            grams = np.flatnonzero(np.bincount(gram, minlength=room))
            place = np.zeros(room, dtype=np.int64)
            place[grams] = np.arange(len(grams))
            gram = place[gram]
        else:
            grams, gram = np.unique(gram, return_inverse=True)
        vectors = np.stack([self.letter(c) for c in alphabet])
        counts = np.bincount(owner.astype(np.int64) * len(grams) + gram, minlength=len(texts) * len(grams)).astype(np.float32).reshape(len(texts), -1)
        for a in range(0, len(grams), 8192):
            part, bound = grams[a : a + 8192], None
            for i in range(n):
                v = np.roll(vectors, i, axis=1)[part % len(alphabet)]
                bound, part = v if bound is None else bound * v, part // len(alphabet)
            out += counts[:, a : a + 8192] @ bound.astype(np.float32)
        return out


def bucket_of(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string")) % modulus


def learn(docs: DataFrame, *, dims: int, n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Prototypes of the languages in column ``lang`` of docs (text, lang); as many numbers as dims x languages."""

    def bundle(batches):
        enc, total = Encoder(dims, n, seed), {}
        for b in batches:
            texts, langs = b["text"].to_pylist(), np.array(b["lang"].to_pylist(), dtype=object)
            at = 0
            for part in enc.chunks(texts):
                v = enc.encode(part)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.rint(np.divide(v * SCALE, size, out=np.zeros_like(v), where=size > 0)).astype(np.int64)
                for lang in set(own := langs[at : at + len(part)]):
                    total[lang] = total.get(lang, 0) + v[own == lang].sum(axis=0)
                at += len(part)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "v": [x.tolist() for x in total.values()]}, pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    sums = (
        docs.where("lang is not null and text is not null")
        .select("text", "lang")
        .mapInArrow(bundle, "lang string, v array<long>")
        .select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
        .toPandas()
    )
    langs = sorted(sums["lang"].unique())
    out = np.zeros((len(langs), dims))
    out[[langs.index(x) for x in sums["lang"]], sums["i"]] = sums["x"]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    keep = size[:, 0] > 0
    return [x for x, k in zip(langs, keep, strict=True) if k], (out[keep] / size[keep]).astype(np.float32)


def identify(docs: DataFrame, *, id_col: str = "doc_id", dims: int = 1024, n: int = 3, seed: int = 7, folds: int = 5, passing: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, lang_pred, score (cosine, 0 to 1) for each row of docs, and its columns named in ``passing`` (names other than
    those four).

    Learns from text and lang of the rows whose crc32(id as text) mod folds is not 0.
    """
    common.ready(docs.sparkSession)
    carried = [f"carried_{i}" for i in range(len(passing))]
    langs, prototypes = learn(docs.where(bucket_of(id_col, folds) != 0), dims=dims, n=n, seed=seed)

    def predict(batches):
        enc = Encoder(dims, n, seed)
        for b in batches:
            names, scores = [], []
            for part in enc.chunks(b["text"].to_pylist()):
                v = enc.encode(part)
                size = np.linalg.norm(v, axis=1)
                if not langs:
                    names += [UND] * len(part)
                    scores += [0.0] * len(part)
                    continue
                cos = np.divide(v @ prototypes.T, size[:, None], out=np.zeros((len(part), len(langs)), dtype=np.float32), where=size[:, None] > 0)
                best = cos.argmax(axis=1)
                names += [langs[i] if s > 0 else UND for i, s in zip(best, size, strict=True)]
                scores += np.where(size > 0, np.clip(cos.max(axis=1), 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *(b[c] for c in carried)], names=["id", "held_out", "lang_pred", "score", *carried])

    held = F.coalesce(bucket_of(id_col, folds) == 0, F.lit(False))
    own = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), "text", *(F.col(c).alias(x) for c, x in zip(passing, carried, strict=True)))
    kinds = "".join(f", {x} {own.schema[x].dataType.simpleString()}" for x in carried)
    out = own.mapInArrow(predict, f"id {own.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double{kinds}")
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", *(F.col(x).alias(c) for c, x in zip(passing, carried, strict=True)))
