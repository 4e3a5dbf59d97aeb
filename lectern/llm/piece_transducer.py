"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled into three machines: the normaliser (a space becomes U+2581, one is
put before a text that isn't empty), the piece lexicon (a trie over characters, which
spells pieces) and byte fallback (a character without a piece spells its bytes). The
composition with an input is a lattice of positions; its tropical shortest path is the
encoding.

Weights. A unigram model's arcs weigh minus the piece's score. The published model is BPE,
whose merges are no sum of piece weights; but a sequence is the BPE encoding exactly if
each two neighbouring pieces are the BPE encoding of their own concatenation. So the
lexicon is composed with the acceptor of such neighbours: an arc weighs 0 after a piece
it may follow and infinity after any other. One path of weight 0 is left, and it has one
last piece at each position, so the shortest path is a single forward pass.

No arc spans two characters that stand side by side in no piece. Inputs are cut there,
and equal segments of a task, by their characters, share one composition. Segments that
are new are gathered over a batch and composed together, by length.

Defined results: null and empty texts have no tokens and decode to the empty text (null
stays null); a U+2581 in a text decodes to a space, as in the library.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, others, own, table, tidy, widened
from .kernels import U64, chunks, distinct_spans, mix

SPACE = 0x2581
MEMORY = 1 << 18  # segments, and verdicts of long segments, that a task remembers from batch to batch
PART = 1 << 19  # bytes of text that are cut at once, one text at least
WAITING = 1 << 21  # characters of new segments that wait before their paths are found
PATHS = 1 << 18  # characters of segments whose paths are found at once
SLOTS = 1 << 20  # of the neighbour table
LONG = 200  # characters of a segment above which its path is found alone
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def read_model(data: bytes) -> dict:
    """Pieces, scores, kinds and the normaliser's settings of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(data)
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only the identity normaliser that keeps white space is compiled")
    if any(p.type == USER for p in m.pieces):
        raise ValueError("user-defined pieces are not compiled")
    return {"pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "kinds": [p.type for p in m.pieces], "prefix": m.normalizer_spec.add_dummy_prefix, "bpe": m.trainer_spec.model_type == pb.TrainerSpec.BPE, "unk": m.trainer_spec.unk_id}


def merge(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Plain BPE: the best-ranked neighbours merge, leftmost first, until none is a piece."""
    while len(symbols) > 1:
        best = min(((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))))
        if best[0] == 1 << 60:
            return symbols
        i = best[1]
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
    return symbols


class Transducer:
    """The compiled machines, as arrays."""

    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        self.prefix, self.bpe = model["prefix"], model["bpe"]
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        alphabet = sorted({c for p in ids for c in p})
        self.chars = np.array([ord(c) for c in alphabet], dtype=np.uint32)
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        n = len(alphabet) + 1
        self.width = n
        # states are renumbered: single characters first, then pieces by rank, so that a later number merges later
        single = [p for p in ids if len(p) == 1]
        order = sorted((p for p in ids if len(p) > 1), key=lambda p: (-model["scores"][ids[p]], ids[p]))
        if self.bpe:
            rank, kept, splits = {}, [], []
            for p in order:
                parts = merge(list(p), rank)
                if len(parts) == 2:
                    splits.append(parts)
                    kept.append(p)
                    rank[p] = len(rank)
            order = kept
        lexicon = single + order
        at = {p: i for i, p in enumerate(lexicon)}
        # a character that has no piece of its own is a state too, which only byte fallback can leave
        for c in alphabet:
            if c not in at:
                at[c] = len(at)
                lexicon.append(c)
        self.ids = np.array([ids.get(p, -1) for p in lexicon], dtype=np.int32)
        self.cost = np.array([-model["scores"][ids[p]] if p in ids else np.inf for p in lexicon], dtype=np.float64)
        self.left, self.right = np.arange(len(lexicon)), np.arange(len(lexicon))
        if self.bpe:
            for p, (a, b) in zip(order, splits):
                self.left[at[p]], self.right[at[p]] = at[a], at[b]
            keys = np.array([at[a] * len(lexicon) + at[b] for a, b in splits], dtype=np.int64)
            by = np.argsort(keys)
            self.pair_keys, self.pair_rank = keys[by], np.array([at[p] for p in order], dtype=np.int64)[by]
        self.longest = max(map(len, lexicon), default=1)
        # trie: (state, character) -> state, by a sorted table
        nodes, final = {(): 0}, {}
        edges = {}
        for p in lexicon:
            if p not in ids:
                continue
            path = ()
            for c in p:
                step = (*path, number[c])
                if step not in nodes:
                    nodes[step] = len(nodes)
                    edges[nodes[path] * n + number[c]] = nodes[step]
                path = step
            final[nodes[path]] = at[p]
        self.edge_keys = np.array(sorted(edges), dtype=np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], dtype=np.int32)
        self.final = np.full(len(nodes), -1, dtype=np.int32)
        self.final[list(final)] = list(final.values())
        pairs = np.unique(np.array([number[a] * n + number[b] for p in ids for a, b in zip(p, p[1:])], dtype=np.int64))
        self.joined = np.zeros(n * n // 8 + 1, dtype=np.uint8)
        np.bitwise_or.at(self.joined, pairs >> 3, (1 << (pairs & 7)).astype(np.uint8))
        self.bytes_id = np.full(256, model["unk"], dtype=np.int32)
        fallback = False
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == BYTE:
                self.bytes_id[int(p[3:-1], 16)] = i
                fallback = True
        self.fallback, self.unk = fallback, model["unk"]
        # decoding: the bytes of each id
        spell = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace("▁", " ").encode() for p, k in zip(pieces, kinds)]
        self.out_len = np.array([len(s) for s in spell], dtype=np.int64)
        self.out_at = np.concatenate(([0], np.cumsum(self.out_len)))[:-1]
        self.out = np.frombuffer(b"".join(spell), dtype=np.uint8)


class Encoder:
    """Compositions of inputs with a transducer; remembers segments and neighbours."""

    def __init__(self, t: Transducer):
        self.t = t
        self.slot_key = np.full(SLOTS, -1, dtype=np.int64)
        self.slot_ok = np.zeros(SLOTS, dtype=bool)
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}  # segment -> its row in place and size
        self.place, self.size, self.store = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.waiting, self.wait = [], 0  # segments without a path yet, the last rows

    # -- the acceptor of neighbours
    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a: no merge across their border comes before the border is fixed."""
        t, m = self.t, len(self.t.ids)
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = a * m + b
            at = np.minimum(np.searchsorted(t.pair_keys, key), max(len(t.pair_keys) - 1, 0))
            bad = (t.pair_keys[at] == key) & (t.pair_rank[at] < limit) if len(t.pair_keys) else np.zeros(len(a), dtype=bool)
            ok[live[bad]] = False
            # undo the later of the two merges: the border then touches an inner piece
            can_a, can_b = t.right[a] != a, t.left[b] != b
            split_a = can_a & ((a > b) | ~can_b)
            split_b = can_b & ~split_a
            go = ~bad & (split_a | split_b)
            limit = np.where(split_a, a, b + 1)[go]
            a, b = np.where(split_a, t.right[a], a)[go], np.where(split_b, t.left[b], b)[go]
            live = live[go]
        return ok

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.t.ids) + b
        slot = (mix(key.astype(np.uint64)) & U64(SLOTS - 1)).astype(np.int64)
        ok = self.slot_ok[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            judged = self._judge(new // len(self.t.ids), new % len(self.t.ids))
            ok[miss] = judged[back.ravel()]
            to = (mix(new.astype(np.uint64)) & U64(SLOTS - 1)).astype(np.int64)
            self.slot_key[to], self.slot_ok[to] = new, judged
            # of two keys in one slot the last stays; its verdict must be its own
            both = self.slot_key[to] == new
            self.slot_ok[to[both]] = judged[both]
        return ok

    # -- shortest paths
    def _paths(self, x: np.ndarray):
        """Encodings of the rows of x (equal lengths, known characters): states, row by row, and their counts."""
        t, (m, n) = self.t, x.shape
        spelled = {}
        for i in range(n):
            node, rows = np.zeros(m, dtype=np.int64), np.arange(m)
            for w in range(1, min(t.longest, n - i) + 1):
                key = node * t.width + x[rows, i + w - 1]
                at = np.minimum(np.searchsorted(t.edge_keys, key), len(t.edge_keys) - 1)
                live = t.edge_keys[at] == key
                rows, node = rows[live], t.edge_to[at[live]].astype(np.int64)
                if not len(rows):
                    break
                end = t.final[node]
                hit = end >= 0
                if hit.any():
                    spelled[i, w] = rows[hit], end[hit].astype(np.int64)
        last = np.full((n + 1, m), -1, dtype=np.int64)
        came = np.zeros((n + 1, m), dtype=np.int32)
        weight = np.full((n + 1, m), np.inf)
        weight[0] = 0
        for end in range(1, n + 1):
            for w in range(min(t.longest, end), 0, -1):  # of equal weights the earliest start, as in the library
                if (end - w, w) not in spelled:
                    continue
                rows, piece = spelled[end - w, w]
                total = weight[end - w, rows] + (0 if t.bpe else t.cost[piece])
                ok = total < weight[end, rows]
                rows, piece, total = rows[ok], piece[ok], total[ok]
                if t.bpe and end > w and len(rows):
                    ok = self.may_follow(last[end - w, rows], piece)
                    rows, piece, total = rows[ok], piece[ok], total[ok]
                last[end, rows], came[end, rows], weight[end, rows] = piece, w, total
        pos, parts = np.full(m, n), []
        while (live := np.flatnonzero(pos > 0)).size:
            parts.append((live, last[pos[live], live]))
            pos[live] -= came[pos[live], live]
        rows, states = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        step = np.concatenate([np.full(len(p[0]), -i) for i, p in enumerate(parts)])
        by = np.lexsort((step, rows))
        return states[by], np.bincount(rows, minlength=m)

    def _follows(self, a: int, b: int) -> bool:
        """The verdict of `_judge` on one pair."""
        t, m, limit = self.t, len(self.t.ids), 1 << 62
        left, right, rank = self.tables()
        while True:
            if rank.get(a * m + b, limit) < limit:
                return False
            can_a, can_b = right[a] != a, left[b] != b
            if can_a and (a > b or not can_b):
                a, limit = right[a], a
            elif can_b:
                b, limit = left[b], b + 1
            else:
                return True

    def tables(self):
        """The merges as Python objects, for long segments."""
        if not hasattr(self, "_tables"):
            t = self.t
            self._tables = t.left.tolist(), t.right.tolist(), dict(zip(t.pair_keys.tolist(), t.pair_rank.tolist())) if t.bpe else {}
            self._edges, self._final = dict(zip(t.edge_keys.tolist(), t.edge_to.tolist())), t.final.tolist()
            self._verdicts: dict[int, bool] = {}
        return self._tables

    def _long_path(self, x: list[int]) -> np.ndarray:
        """The states of the shortest path of one long segment; time and memory follow its length."""
        self.tables()
        t, n, m = self.t, len(x), len(self.t.ids)
        edges, final, verdicts, width, cost = self._edges, self._final, self._verdicts, t.width, t.cost.tolist()
        last, came, weight = [-1] * (n + 1), [0] * (n + 1), [np.inf] * (n + 1)
        weight[0] = 0.0
        for i in range(n):
            if weight[i] == np.inf:
                continue
            node, before = 0, last[i]
            for j in range(i, n):
                node = edges.get(node * width + x[j], -1)
                if node < 0:
                    break
                piece = final[node]
                if piece < 0:
                    continue
                total = weight[i] + (0.0 if t.bpe else cost[piece])
                if total >= weight[j + 1]:
                    continue
                if t.bpe and i:
                    key = before * m + piece
                    ok = verdicts.get(key)
                    if ok is None:
                        if len(verdicts) > MEMORY:
                            verdicts.clear()
                        ok = verdicts[key] = self._follows(before, piece)
                    if not ok:
                        continue
                last[j + 1], came[j + 1], weight[j + 1] = piece, i, total
        out, i = [], n
        while i:
            out.append(last[i])
            i = came[i]
        return np.array(out[::-1], dtype=np.int64)

    def _solve(self, cid: np.ndarray, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Ids of all segments, by length; where each segment's begin, and their counts."""
        t = self.t
        length, out, at = ends - starts, [], 0
        place, counts = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)

        def put(part, ids, sizes):
            nonlocal at
            place[part], counts[part] = at + np.cumsum(sizes) - sizes, sizes
            out.append(ids)
            at += len(ids)

        unknown = cid[starts] == 0
        for i in np.flatnonzero(unknown):
            ids = t.bytes_id[np.frombuffer("".join(map(chr, cps[starts[i] : ends[i]])).encode("utf-8"), dtype=np.uint8)] if t.fallback else np.array([t.unk], dtype=np.int32)
            put([i], ids, len(ids))
        known = np.flatnonzero(~unknown)
        for i in known[length[known] > LONG]:
            ids = t.ids[self._long_path(cid[starts[i] : ends[i]].tolist())]
            put([i], ids, len(ids))
        known = known[length[known] <= LONG]
        for n in np.unique(length[known]):
            group = known[length[known] == n]
            most = max(1, PATHS // int(n))
            for k in range(0, len(group), most):
                part = group[k : k + most]
                states, sizes = self._paths(cid[starts[part][:, None] + np.arange(n)].astype(np.int64))
                put(part, t.ids[states], sizes)
        return out, place, counts

    def look(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the segments of all texts, one text after the other, and how many each text has; new segments wait for `settle`."""
        t = self.t
        lengths = np.array([len(x) + (1 if x and t.prefix else 0) for x in text], dtype=np.int64)
        whole = "".join(" " + x if x and t.prefix else x for x in text)
        if not whole:
            return np.zeros(0, dtype=np.int32), np.zeros(len(text), dtype=np.int64)
        cps = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32).copy()
        cps[cps == 0x20] = SPACE
        at = np.minimum(np.searchsorted(t.chars, cps), len(t.chars) - 1)
        cid = np.where(t.chars[at] == cps, at + 1, 0)
        edge = cid[:-1] * t.width + cid[1:]
        cut = np.ones(len(cps), dtype=bool)
        cut[1:] = (t.joined[edge >> 3] >> (edge & 7).astype(np.uint8)) & 1 == 0
        offs = np.concatenate(([0], np.cumsum(lengths)))
        cut[offs[:-1][lengths > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(cps))
        row = np.searchsorted(offs, starts, side="right") - 1
        first, number = distinct_spans(cps.view(np.uint8), starts * 4, ends * 4)
        parts = [whole[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())]
        new = [i for i, x in enumerate(parts) if x not in self.known]
        if new:
            self.known.update(zip([parts[i] for i in new], range(len(self.known), len(self.known) + len(new))))
            a, n = starts[first[new]], (ends - starts)[first[new]]
            index = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.waiting.append((cid[index].astype(np.int32), cps[index], n))
            self.wait += len(index)
            if self.wait > WAITING:
                self.settle()
        return np.array([self.known[x] for x in parts], dtype=np.int32)[number], np.bincount(row, minlength=len(text))

    def settle(self) -> None:
        """Finds the paths of the segments that wait."""
        if not self.waiting:
            return
        cid, cps, length = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.wait = [], 0
        ends = np.cumsum(length)
        found, place, counts = self._solve(cid, cps, ends - length, ends)
        self.place, self.size = np.concatenate((self.place, place + len(self.store))), np.concatenate((self.size, counts))
        self.store = np.concatenate((self.store, *found))

    def ids(self, rows: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose segments are settled, one text after the other, and the count of each."""
        place, size = self.place[rows], self.size[rows]
        index = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())
        total = np.concatenate(([0], np.cumsum(size)))
        return self.store[index], np.diff(total[np.concatenate(([0], np.cumsum(segments)))])

    def encode(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the count of each."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each list of texts the ids of all, one after the other, and the count of each."""
        if len(self.known) > MEMORY:
            self.forget()
        looked = [self.look(text) for text in texts]
        self.settle()
        for rows, segments in looked:
            yield self.ids(rows, segments)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of id sequences that stand one after the other."""
        t = self.t
        size = t.out_len[ids]
        index = np.repeat(t.out_at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        raw = t.out[index].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return [x[1:] if t.prefix and x.startswith(" ") else x for x in texts]


def compile_model(data: bytes) -> Transducer:
    return Transducer(read_model(data))


def sentencepiece(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with the piece ids of the text and the text decoded from these ids. model: the model file's content."""
    spark = docs.sparkSession
    arrow_rows(spark)
    machine = spark.sparkContext.broadcast(compile_model(model))
    a, b = own("ids"), own("decoded")

    def run(batches):
        encoder = Encoder(machine.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            ids, offs, decoded = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)], []
            for got, counts in encoder.encode_all([x or "" for x in column.slice(first, end - first).to_pylist()] for first, end, _, _ in chunks(column, PART)):
                ids.append(got)
                offs.append(np.cumsum(counts) + offs[-1][-1])
                decoded += encoder.decode(got, counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offs), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            missing = column.is_null().to_pylist()
            texts = pa.array([None if m else x for m, x in zip(missing, decoded)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, texts], names=[*batch.schema.names, a, b])

    out = docs.mapInArrow(tidy(run), widened(docs, **{a: "array<int>", b: "string"}))
    return out.select(*others(docs, ids_col, decoded_col), F.col(a).alias(ids_col), F.col(b).alias(decoded_col))


def model_bytes() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def tokenized_documents(docs: DataFrame) -> DataFrame:
    """The documents with n_tokens, piece_ids and decoded."""
    out = sentencepiece(docs, model_bytes())
    return out.withColumn("n_tokens", F.size("piece_ids").cast("long"))


def op10_sentencepiece(spark, sf_dir):
    out = sentencepiece(table(spark, sf_dir, "documents").select("doc_id", "text"), model_bytes())
    same = F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" ")) == F.coalesce("decoded", F.lit(""))
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("piece_ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.coalesce("decoded", F.lit("")).cast("binary"), 256).alias("decoded_sha256"), same.alias("round_trip"))
