"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import _BASE, chunks, dealt, free, from_planes, mix, planes, slices_of, text_or_empty, tidy, unzipped, word_hashes, written, zipped

END, BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x8CB92BA72F3D8DD7)
FLUSH = 1_000_000  # tokens that a task holds before it deals its counts out


class Quantiser:
    """Counts as levels 1 + floor(log_base(count)); a level stands for its least count, so no sum of counts is exceeded."""

    def __init__(self, base: float):
        self.base = base
        edges = [1]
        while edges[-1] < 1 << 62:
            edges.append(max(edges[-1] + 1, int(np.ceil(edges[0] * base ** len(edges)))))
        self.edges = np.array(edges[:-1], dtype=np.int64)  # the least count of each level
        self.value = np.concatenate(([0.0], self.edges.astype(float)))

    def level(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, counts, side="right")


class LogBloom:
    """Sliced Bloom filter: an n-gram of level q is put in once for each level 1..q.

    A look-up asks for level 1, 2, ... until one is missing, so a stored n-gram is
    never underestimated. Level 1 takes ``first`` bits, so an n-gram that was never
    stored is found with probability 2^-first; further levels take ``probes`` each.
    """

    def __init__(self, slices: int, probes: int, first: int):
        self.slices, self.probes, self.first = slices, probes, first

    def probes_at(self, level: int) -> int:
        return self.first if level == 1 else self.probes

    @staticmethod
    def spots(keys: np.ndarray, level: int, probe: int, bits) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = mix(keys + np.uint64(level * 64 + probe + 1) * np.uint64(0xA0761D6478BD642F))
        bits = np.asarray(bits, dtype=np.uint64)
        return ((x >> np.uint64(32)) * bits) >> np.uint64(32) if bits.max(initial=0) < 1 << 32 else x % bits

    def build(self, keys: np.ndarray, levels: np.ndarray) -> bytes:
        """The bits of one slice: as many as its entries need at half filling."""
        entries = levels.sum() * self.probes + len(levels) * (self.first - self.probes)
        bits = 64 * max(1, int(np.ceil(entries / np.log(2) / 64)))
        field = np.zeros(bits, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            some = keys[levels >= level]
            for p in range(self.probes_at(level)):
                field[self.spots(some, level, p, bits).astype(np.int64)] = True
        return np.packbits(field, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray, field: np.ndarray, start: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
        """Levels of keys in the slices at hand: ``start`` (in bytes) and ``bits`` by slice, bits 0 where absent."""
        where = (keys % np.uint64(self.slices)).astype(np.int64)
        out = np.zeros(len(keys), dtype=np.uint8)
        alive = np.flatnonzero(bits[where] > 0)
        for level in range(1, most + 1):
            for p in range(self.probes_at(level)):
                if not len(alive):
                    return out
                w = where[alive]
                spot = self.spots(keys[alive], level, p, bits[w])
                byte = field[start[w] + (spot >> np.uint64(3)).astype(np.int64)]
                alive = alive[((byte >> (spot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
            out[alive] = level
        return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts (words, then one end each), their contexts, and the offsets of texts."""
    words, at = word_hashes(column)
    n = len(column)
    offsets = at + np.arange(n + 1)
    out = np.empty(len(words) + n, dtype=np.uint64)
    ends = offsets[1:] - 1
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner] = words
    out[ends] = END
    context = np.empty_like(out)
    context[1:] = out[:-1]
    context[offsets[:-1]] = BEGIN
    return out, context, offsets


def pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """56-bit hashes of neighbouring tokens: they travel in fewer bytes, and the filter errs more often than they collide."""
    with np.errstate(over="ignore"):
        return mix(context * _BASE + token * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(8)


def _sorted_bytes(x: np.ndarray) -> np.ndarray:
    """Ascending hashes as the planes of their differences."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def _from_sorted(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(from_planes(raw, "<u8"), dtype=np.uint64)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _count(slices: int):
    """Word and pair counts of a task's texts, packed per slice of the hash; kind 1 words, 2 pairs."""

    def counted(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            nonlocal held, n
            t, c = (np.concatenate(x) for x in zip(*held))
            held, n = [], 0
            rows = []
            for kind, keys in ((1, t), (2, pair(c, t))):
                k, m = np.unique(keys, return_counts=True)
                for s, part in dealt((k % np.uint64(slices)).astype(np.int64), slices):
                    rows.append((s, kind, len(part), zipped(_sorted_bytes(k[part]), planes(m[part].astype("<u4")))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["slice", "kind", "n", "grams"])

        for b in chunks(batches):
            t, c, _ = tokens(b.column("text"))
            held.append((t, c))
            n += len(t)
            if n >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return tidy(counted)


def _merge(bloom: LogBloom, base: float):
    """Of a slice: its words with exact counts, and its part of the filter of pairs."""

    def merged(table: pa.Table) -> pa.Table:
        got = {}
        kinds, sizes, blobs = (table.column(c).to_pylist() for c in ("kind", "n", "grams"))
        for kind in (1, 2):
            parts = [unzipped(b, 12 * n, "<u1")[0] for k, n, b in zip(kinds, sizes, blobs) if k == kind]
            if parts:
                cut = [len(p) // 12 * 8 for p in parts]
                keys, counts = (np.concatenate(x) for x in ([_from_sorted(p[:i]) for p, i in zip(parts, cut)], [from_planes(p[i:], "<u4") for p, i in zip(parts, cut)]))
                got[kind] = _sum_by(keys, counts.astype(np.int64))
            else:
                got[kind] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        words, counts = got[1]
        levels = Quantiser(base).level(got[2][1])
        field = bloom.build(got[2][0], levels)
        return pa.table({
            "slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "n_words": pa.array([len(words)], pa.int64()), "n_tokens": pa.array([int(counts.sum())], pa.int64()),
            "starts": pa.array([int(counts[words == END].sum())], pa.int64()), "words": pa.array([zipped(words, counts)], pa.binary()),
            "field": pa.array([field], pa.binary()), "bytes": pa.array([len(field)], pa.int64()), "top": pa.array([int(levels.max(initial=0))], pa.int32()),
        })

    return tidy(merged)


_MODEL = "slice int, n_words long, n_tokens long, starts long, words binary, field binary, bytes long, top int"
#: A piece is the stretch of texts that a task scores at once. ``entries`` asks a slice for n_words words and n_pairs pairs, or holds its answers; ``body`` is the piece itself.
_SENT = "slice int, piece long, n_words long, n_pairs long, entries binary, body binary"
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_PART = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def corpus_counts(docs: DataFrame, slices: int, bloom: LogBloom, base: float) -> DataFrame:
    """The written model table: a row per slice with its words' exact counts and its part of the filter."""
    return written(docs.mapInArrow(_count(slices), "slice int, kind int, n long, grams binary").groupBy("slice").applyInArrow(_merge(bloom, base), _MODEL))


def score_texts(df: DataFrame, is_training, order_base: float = 1.5, probes: int = 6, first: int = 12, prior: float = 20.0, max_filter_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    base_score sums log10((c + 1) / (N + V + 1)) with exact counts c. score sums
    log10((q(v w) + prior * p(w)) / (c(v) + prior)), with p(w) = (c(w) + 1) / (N + V + 1)
    and the quantised count q found by probing the filter, which holds all pairs
    of neighbouring tokens. q stands for the least count of its level, so over all w
    the probabilities after v sum to 1 at most; what quantising takes away stays
    unspent. A pair that was never seen is taken for one with probability 2^-first.

    The filter is broadcast up to ``max_filter_bytes``. A larger one is not
    gathered anywhere: pieces of the corpus send their distinct pairs to the
    filter's slices and get levels back, with the same result. Word counts are
    looked up in slices likewise. Slices grow with the input.

    Words are compared by 64-bit hashes. A null or empty text is only its end;
    repeated rows and ids are scored, and learned from, each for itself; a text is
    held whole in a task. Without training texts all scores are 0.
    """
    spark = df.sparkSession
    slices = slices_of(df)
    bloom = LogBloom(slices, probes, first)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), is_training.alias("trains"))
    model = corpus_counts(docs.filter("trains").select("text"), slices, bloom, order_base)
    free(spark)
    total = model.agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_words", "starts", "bytes")], F.max("top").alias("top")).first()
    n, v, starts, top = (total[c] or 0 for c in ("n_tokens", "n_words", "starts", "top"))
    whole = None
    if (total["bytes"] or 0) <= max_filter_bytes:
        start, bits, at, fields = np.zeros(slices, np.int64), np.zeros(slices, np.int64), 0, []
        for r in model.select("slice", "field").collect():  # max_filter_bytes at most
            start[r["slice"]], bits[r["slice"]] = at, 8 * len(r["field"])
            at += len(r["field"])
            fields.append(r["field"])
        whole = spark.sparkContext.broadcast((b"".join(fields), start, bits))
    texts = docs.select("doc_id", "text")
    sent = texts.mapInArrow(_ask(slices, whole is None), _SENT)
    answers = sent.groupBy("slice").cogroup(model.select("slice", "n_words", "words", "field").groupBy("slice")).applyInArrow(_answer(bloom, top), _SENT)
    # the texts are read once more for the pieces, which so travel once only
    scored = answers.unionByName(texts.mapInArrow(_bodies(bloom, whole, top), _SENT)).groupBy("piece").applyInArrow(_score(slices, whole is not None, Quantiser(order_base).value, n, v, starts, prior), _PART)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _pairs(words: np.ndarray, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece: hashes of its distinct pairs, their context and last word as places in ``words`` (one beyond them: the text's begin), and the pair of each token."""
    begin = len(words)
    context = np.empty(len(token), np.int64)
    context[1:] = token[:-1]
    context[first] = begin
    code, back = np.unique(context * (begin + 1) + token, return_inverse=True)
    before, last = code // (begin + 1), code % (begin + 1)
    return pair(np.append(words, BEGIN)[before], words[last]), before, last, back


def _by_slice(keys: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by slice and value, and where each slice begins in it."""
    where = (keys % np.uint64(slices)).astype(np.int64)
    order = np.lexsort((keys, where))
    return order, np.searchsorted(where[order], np.arange(slices + 1))


def _pieces(batches):
    """(piece, batch, its distinct words, the word of each token, offsets of texts) of stretches of texts.

    A piece's number is a hash of its ids and tokens: whichever task reads it gives
    it the same one, and pieces of one number are alike.
    """
    for b in chunks(batches, limit=4 << 20):
        t, _, offsets = tokens(b.column("text"))
        words, token = np.unique(t, return_inverse=True)
        with np.errstate(over="ignore"):
            places = mix(np.arange(max(len(t), len(offsets)), dtype=np.uint64))
            ids = b.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
            piece = mix(t ^ places[: len(t)]).sum(dtype=np.uint64) + mix(mix(ids) ^ places[: len(ids)] ^ offsets[1:].astype(np.uint64)).sum(dtype=np.uint64)
        yield int(np.array([piece], np.uint64).view(np.int64)[0]), b, words, token, offsets


def _ask(slices: int, pairs: bool):
    """Of each piece, by slice: its distinct words and (if no whole filter is at hand) pairs."""

    def asked(batches):
        for piece, _, words, token, offsets in _pieces(batches):
            keys = _pairs(words, token, offsets[:-1])[0] if pairs else np.zeros(0, np.uint64)
            word_order, word_cut = _by_slice(words, slices)
            pair_order, pair_cut = _by_slice(keys, slices)
            rows = []
            for s in np.flatnonzero((np.diff(word_cut) > 0) | (np.diff(pair_cut) > 0)).tolist():
                w, p = words[word_order[word_cut[s] : word_cut[s + 1]]], keys[pair_order[pair_cut[s] : pair_cut[s + 1]]]
                rows.append((s, piece, len(w), len(p), zipped(_sorted_bytes(w), _sorted_bytes(p)), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _SENT.replace(",", "").split()[::2])

    return tidy(asked)


def _bodies(bloom: LogBloom, whole, top: int):
    """The pieces themselves: ids, lengths, words and tokens, and the levels of their pairs in a whole filter."""

    def packed(batches):
        for piece, b, words, token, offsets in _pieces(batches):
            levels = b""
            if whole is not None:
                blob, start, bits = whole.value
                levels = bloom.levels(_pairs(words, token, offsets[:-1])[0], np.frombuffer(blob, np.uint8), start, bits, top).tobytes()
            ids = b.column("doc_id")
            known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
            ids = ids.fill_null(0).to_numpy()
            sizes = np.array([len(ids), len(words), len(token), len(levels)], np.int64)
            body = sizes.tobytes() + zipped(ids, known.astype(np.uint8), np.diff(offsets).astype("<i8"), _sorted_bytes(words), planes(token.astype("<u4")), np.frombuffer(levels, np.uint8))
            row = (-1, piece, 0, 0, None, body)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS)], _SENT.replace(",", "").split()[::2])

    return tidy(packed)


def _answer(bloom: LogBloom, top: int):
    """Of a slice: the exact counts of the words and the levels of the pairs that pieces ask for, in their order."""

    def answered(sent: pa.Table, model: pa.Table) -> pa.Table:
        words, counts, field = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        if model.num_rows:
            words, counts = unzipped(model.column("words")[0].as_py(), model.column("n_words")[0].as_py(), "<u8", "<i8")
            field = np.frombuffer(model.column("field")[0].as_py(), np.uint8)
        start, bits = np.zeros(bloom.slices, np.int64), np.full(bloom.slices, 8 * len(field), np.int64)
        out = []
        for n, m, entries in zip(sent.column("n_words").to_pylist(), sent.column("n_pairs").to_pylist(), sent.column("entries").to_pylist()):
            raw = unzipped(entries, 8 * (n + m), "<u1")[0]
            asked, pairs = _from_sorted(raw[: 8 * n]), _from_sorted(raw[8 * n :])
            count = np.zeros(n, np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                count = np.where(words[at] == asked, counts[at], 0)
            out.append(zipped(planes(count), bloom.levels(pairs, field, start, bits, top)))
        if not sent.num_rows:
            return pa.table([pa.array([], k) for k in _KINDS], names=_SENT.replace(",", "").split()[::2])
        return sent.set_column(4, "entries", pa.array(out, pa.binary()))

    return tidy(answered)


def _score(slices: int, probed: bool, value: np.ndarray, n: int, v: int, starts: int, prior: float):
    """A piece's documents, from the answers of the slices."""

    def scored(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bodies = [r["body"] for r in rows if r["body"] is not None]
        if not bodies:
            raise RuntimeError("the input gave other rows when it was read again")
        return pa.concat_tables([documents(rows, body) for body in bodies])

    def documents(rows: list[dict], body: bytes) -> pa.Table:
        n_docs, n_words, n_tokens, n_levels = np.frombuffer(body, np.int64, 4).tolist()
        raw, at, got = pa.decompress(body[32:], decompressed_size=17 * n_docs + 8 * n_words + 4 * n_tokens + n_levels, codec="zstd", asbytes=True), 0, []
        for kind, size in (("<i8", n_docs), ("<u1", n_docs), ("<i8", n_docs), ("<u1", 8 * n_words), ("<u1", 4 * n_tokens), ("<u1", n_levels)):
            got.append(np.frombuffer(raw, kind, size, at))
            at += got[-1].nbytes
        ids, known_id, size, words, token, levels = got
        words, token = _from_sorted(words), from_planes(token, "<u4").astype(np.int64)
        first = np.cumsum(size) - size
        keys, before, last, back = _pairs(words, token, first)
        word_order, word_cut = _by_slice(words, slices)
        pair_order, pair_cut = _by_slice(keys, slices)
        count = np.zeros(n_words + 1, np.int64)
        found = levels if probed else np.zeros(len(keys), np.uint8)
        for r in rows:
            if r["entries"] is None:
                continue
            raw = pa.decompress(r["entries"], decompressed_size=8 * r["n_words"] + r["n_pairs"], codec="zstd", asbytes=True)
            s = r["slice"]
            count[word_order[word_cut[s] : word_cut[s + 1]]] = from_planes(np.frombuffer(raw, "<u1", 8 * r["n_words"]), "<i8")
            if not probed:
                found[pair_order[pair_cut[s] : pair_cut[s + 1]]] = np.frombuffer(raw, "<u1", r["n_pairs"], 8 * r["n_words"])
        count[n_words] = starts  # as many texts begin as end
        c = count[:n_words][token]
        joint = np.minimum(value[found], np.minimum(count[before], count[last]))
        p = (count[last] + 1) / (n + v + 1)
        log = np.log10((joint + prior * p) / (count[before] + prior)) if n else np.zeros(len(keys))
        base = np.log10((c + 1) / (n + v + 1))
        return pa.table({
            "doc_id": pa.array(ids, mask=known_id == 0), "n_tokens": pa.array(size), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
            "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(log[back], first)),
        })

    return tidy(scored)
