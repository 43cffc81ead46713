"""Encoding and decoding by a sentencepiece BPE model, by rounds of merges on arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .spaced import ragged, stretches, words_of

MODEL = "piece_bpe_32k.model"
SPACE, NEVER, LONG = "▁", np.int32(2**31 - 1), 64


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _merged_run(n: int, sizes: set[int]) -> list[int]:
    """What n equal characters end as, if two neighbours of together a size in ``sizes`` merge, always the leftmost."""
    runs, at = [1] * n, 0
    while at + 1 < len(runs):
        if runs[at] + runs[at + 1] in sizes:
            runs[at : at + 2], at = [runs[at] + runs[at + 1]], 0
        else:
            at += 1
    return runs


class Vocabulary:
    """The pieces of a model, the pairs of pieces that merge, and in what order.

    Two neighbours merge if they spell a piece; the pair of the piece with the highest score merges first, of equal ones
    the leftmost.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.begin, self.end, self.unknown = model.get_piece_size(), model.bos_id(), model.eos_id(), model.unk_id()
        every = range(self.size)
        self.names = [model.id_to_piece(i) for i in every]
        self.bytes = {int(self.names[i][3:5], 16): i for i in every if model.is_byte(i)}
        own = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {self.names[i]: i for i in own}
        scores = np.array([model.get_score(i) for i in every])
        rank_of = np.searchsorted(np.unique(-scores[own]), -scores).astype(np.int32)
        self._tables(rank_of)
        self._outputs([model.is_control(i) for i in every])

    def _tables(self, rank_of: np.ndarray) -> None:
        pairs = [(self.ids[w[:k]], self.ids[w[k:]], i) for w, i in self.ids.items() for k in range(1, len(w)) if w[:k] in self.ids and w[k:] in self.ids]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        order = np.argsort(left * self.size + right)
        self.keys, self.made = (left * self.size + right)[order], made[order]
        self.ranks = rank_of[self.made]
        # a piece is early if a neighbour can follow it at once with a rank that is no higher than its own
        self.early = np.zeros(self.size, bool)
        for side in (left, right):
            self.early[side[rank_of[side] >= rank_of[made]]] = True
        # pieces that share a rank are left to right: all of them must be runs of one character
        merged = np.unique(made)
        ranks, n = np.unique(rank_of[merged], return_counts=True)
        tied = merged[np.isin(rank_of[merged], ranks[n > 1])]
        self.tied_rank = np.int32(rank_of[tied[0]]) if len(tied) else NEVER - 1
        names = sorted((self.names[i] for i in tied), key=len)
        if any(set(w) != {names[0][0]} for w in names):
            raise ValueError("pieces of equal scores must be runs of one character")
        self.run = len(names[-1]) if names else 1
        # [n, k]: the id that begins at the k-th of n such characters, 0 where none does; more than the longest piece has come in blocks of that
        self.run_ids = np.zeros((self.run + 1, self.run), np.int64)
        for n in range(1, self.run + 1 if names else 0):
            at = 0
            for size in _merged_run(n, {len(w) for w in names}):
                self.run_ids[n, at], at = self.ids[names[0][0] * size], at + size
        if names and _merged_run(2 * self.run, {len(w) for w in names}) != [self.run] * 2:
            raise ValueError("long runs must fall into the longest piece")
        single = sorted((ord(w), i) for w, i in self.ids.items() if len(w) == 1)
        self.points, self.point_ids = np.array(single, np.int64).reshape(-1, 2).T
        self._live = None

    def _outputs(self, control: list[bool]) -> None:
        """What each id spells: its bytes, in one array."""
        spelled = [b"" if control[i] else b" \xe2\x81\x87 " if i == self.unknown else self.names[i].replace(SPACE, " ").encode() for i in range(self.size)]
        for value, i in self.bytes.items():
            spelled[i] = bytes([value])
        self.spelled = spelled
        self.byte_id = np.zeros(self.size, bool)
        self.byte_id[list(self.bytes.values())] = True
        self.byte_ids = np.array([self.bytes.get(v, self.unknown) for v in range(256)])
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    @property
    def live(self) -> np.ndarray:
        """Pairs of pieces that stand side by side inside a piece: between all others no merge can ever reach across."""
        if self._live is None:
            found = set()
            for w in self.ids:
                for a in range(len(w) - 1):
                    for b in range(a + 2, len(w) + 1):
                        found.update(self.ids[w[a:k]] * self.size + self.ids[w[k:b]] for k in range(a + 1, b) if w[a:k] in self.ids and w[k:b] in self.ids)
            self._live = np.array(sorted(found), np.int64)
        return self._live

    def _place(self, keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair is among the sorted ``keys``, and whether it is there."""
        if not len(keys):
            return np.zeros(len(left), np.int64), np.zeros(len(left), bool)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return at, (keys[at] == key) & (left < self.size) & (right < self.size)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = self._place(self.keys, left, right)
        return np.where(there, self.ranks[at], NEVER), self.made[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each. A word is encoded as after a space.

        Each round finds the least rank of a pair in every word and merges the pairs that have it, from the left, those
        that overlap leaving the second out; where the merged piece is early, only the leftmost. Words without a pair
        are done and go. Long words fall apart where no piece reaches across.
        """
        words = [SPACE + w.replace(" ", SPACE) for w in words]
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        first = np.where(self.points[at] == points, self.point_ids[at], self.size + points)  # unknown characters follow the ids
        out, kept = first.copy(), np.ones(len(first), bool)
        sym, seg, pos = first, word, np.arange(len(first))
        rank, made = np.full(len(sym), NEVER), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._rank(sym[:-1], sym[1:])
            rank[:-1][seg[1:] != seg[:-1]] = NEVER
        turn = 0
        while len(sym):
            if not turn & (turn - 1):  # rounds 0, 1, 2, 4, 8, ...
                seg = self._apart(sym, seg)
            turn += 1
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            m = np.repeat(least, sizes)
            hit = (rank == m) & (m < NEVER)
            runs = hit & (m == self.tied_rank)
            places = np.flatnonzero(hit & ~runs)
            if len(places):
                head = np.r_[True, np.diff(places) > 1]
                places = places[(places - np.maximum.accumulate(np.where(head, places, 0))) % 2 == 0]
                s = seg[places]
                places = places[~self.early[made[places]] | np.r_[True, s[1:] != s[:-1]]]
            gone = np.zeros(len(sym), bool)
            gone[places + 1] = True
            sym = sym.copy()
            sym[places] = made[places]
            changed = [places, places[places > 0] - 1]
            if runs.any():
                head, gone_too = self._shorten(sym, runs)
                gone |= gone_too
                rank[runs] = NEVER
            out[pos[places]] = sym[places]
            if runs.any():
                out[pos[head]] = sym[head]
            kept[pos[gone]] = False
            stay = ~gone
            where = np.cumsum(stay) - 1  # places after the gone ones go
            again = np.zeros(len(sym), bool)
            again[where[np.concatenate(changed)]] = True  # the one before a merged pair may itself have gone: then its first half
            again = np.flatnonzero(again[: int(stay.sum())])
            sym, seg, pos, rank, made, done = (x[stay] for x in (sym, seg, pos, rank, made, (m == NEVER) | (m == self.tied_rank)))
            last = np.r_[seg[1:] != seg[:-1], True] if len(seg) else np.zeros(0, bool)
            inner = again[~last[again]] if len(again) else again
            rank[again] = NEVER
            if len(inner):
                rank[inner], made[inner] = self._rank(sym[inner], sym[inner + 1])
            sym, seg, pos, rank, made = (x[~done] for x in (sym, seg, pos, rank, made))
        return self._with_bytes(out[kept], word[kept], len(words))

    def _apart(self, sym: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Segments, numbered anew where a long one can be split."""
        new = np.r_[True, seg[1:] != seg[:-1]]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(seg)])
        if sizes.max() > LONG:
            long = np.flatnonzero(np.repeat(sizes > LONG, sizes) & ~new)
            new[long] = ~self._place(self.live, sym[long - 1], sym[long])[1]
        return np.cumsum(new)

    def _shorten(self, sym: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the character of the tied pieces become these pieces: their heads, and what goes."""
        pairs = np.flatnonzero(runs)
        begin = pairs[np.r_[True, np.diff(pairs) > 1]]
        size = pairs[np.r_[np.diff(pairs) > 1, True]] - begin + 2
        members = ragged(begin, size)
        place = ragged(np.zeros(len(size), np.int64), size)
        ids = self.run_ids[np.minimum(self.run, np.repeat(size, size) - place // self.run * self.run), place % self.run]
        head = members[ids > 0]
        gone = np.zeros(len(sym), bool)
        gone[members[ids == 0]] = True
        sym[head] = ids[ids > 0]
        return head, gone

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd) and not self.bytes:
            sym[odd], odd = self.unknown, odd[:0]
        if len(odd):
            utf8 = [chr(c).encode() for c in sym[odd] - self.size]
            sizes = np.ones(len(sym), np.int64)
            sizes[odd] = [len(b) for b in utf8]
            ends = np.cumsum(sizes)
            word, sym = np.repeat(word, sizes), np.repeat(sym, sizes)
            sym[ragged((ends - sizes)[odd], sizes[odd])] = self.byte_ids[np.frombuffer(b"".join(utf8), np.uint8)]
        return sym, np.bincount(word, minlength=n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each; words that are equal are encoded once. An empty text has the lone space's ids left out."""
        counts, codes, words = words_of(texts)
        ids, sizes = self.encode_words(words)
        starts = np.cumsum(sizes) - sizes
        per_word = sizes[codes]
        total = np.add.reduceat(per_word, np.cumsum(counts) - counts) if len(counts) else counts
        out = ids[ragged(starts[codes], per_word)]
        empty = np.array([not t for t in texts], bool)
        if empty.any():
            out, total = out[~np.repeat(empty, total)], np.where(empty, 0, total)
        return out, total

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        return self.letters[ragged(self.starts[ids], self.lengths[ids])].tobytes()

    def decode(self, ids) -> str:
        """The text of ids: the first piece's leading space goes, runs of byte ids are read as UTF-8, each wrong byte as U+FFFD."""
        ids = np.asarray(ids, np.int64)
        out, at = [], 0
        edges = np.flatnonzero(np.diff(self.byte_id[ids].astype(np.int8))) + 1
        for part in np.split(ids, edges):
            raw = self.spell(part)
            if len(part) and self.byte_id[part[0]]:
                out.append(_utf8(raw))
            else:
                out.append(raw.decode())
        text = "".join(out)
        at = next((i for i in ids.tolist() if self.lengths[i]), None)
        return text[1:] if at is not None and not self.byte_id[at] and self.names[at].startswith(SPACE) else text


def _utf8(raw: bytes) -> str:
    """Bytes as UTF-8, with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + k].decode())
                at += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """A model's vocabulary, read once a worker."""
    return Vocabulary(path)


def _coded(batches: Iterator[pa.RecordBatch], path: str, text: str, ids_too: bool) -> Iterator[pa.RecordBatch]:
    """Each row with the number of its ids and the digests of ids and decoded text, or with the ids and the decoded text themselves."""
    v = vocabulary(path)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).to_pylist()
        n = len(column)
        counts = np.full(n, 2, np.int64)
        coded = [hashlib.sha256(np.array([v.begin], "<u4").tobytes()) for _ in range(n)]
        plain = [hashlib.sha256() for _ in range(n)]
        lists, decoded = [[np.array([v.begin])] for _ in range(n if ids_too else 0)], [[] for _ in range(n if ids_too else 0)]
        for rows, texts, first in stretches(column):
            ids, sizes = v.encode(texts)
            for row, own, begins in zip(rows, np.split(ids, np.cumsum(sizes)[:-1]), first):
                raw = v.spell(own)  # whole characters: a stretch ends between words
                raw = raw[1:] if begins and raw[:1] == b" " else raw
                counts[row] += len(own)
                if ids_too:
                    lists[row].append(own)
                    decoded[row].append(raw)
                else:
                    coded[row].update(own.astype("<u4").tobytes())
                    plain[row].update(raw)
        rest = [batch.column(i) for i, f in enumerate(batch.schema.names) if f != text]
        names = [f for f in batch.schema.names if f != text]
        if ids_too:
            more = [pa.array([np.r_[*own, v.end].astype(np.int32) for own in lists], pa.list_(pa.int32())), pa.array([b"".join(p).decode() for p in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays([*rest, *more], [*names, "ids", "decoded"])
        else:
            end = np.array([v.end], "<u4").tobytes()
            for one in coded:
                one.update(end)
            more = [pa.array(counts), pa.array([h.hexdigest() for h in coded]), pa.array([h.hexdigest() for h in plain])]
            yield pa.RecordBatch.from_arrays([*rest, *more], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>, decoded string) of each row: its text's ids between begin and end, and what they decode to.

    A null or empty text has only begin and end, and decodes to the empty string. Rows stay as they are: null keys and
    repeated rows too; other columns are left out. Texts of any length are worked on in stretches of two million characters.
    """
    kind = docs.schema[key].dataType.simpleString()
    run = partial(_coded, path=path or model_path(MODEL), text=text, ids_too=True)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row, as ``encode`` gives ids and decoded text."""
    kind = docs.schema[key].dataType.simpleString()
    run = partial(_coded, path=path or model_path(MODEL), text=text, ids_too=False)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
