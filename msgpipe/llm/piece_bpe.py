"""SentencePiece BPE by vectorised merge rounds, and its decoding.

A text is cut where no piece of the vocabulary can cross, into *words*. The different
words of a batch form one flat array of symbols. Each round finds for every word the
pair of best rank (a segmented minimum), merges its leftmost occurrences in all words
at once, and compacts the array; words without a mergeable pair leave it.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from msgpipe.llm.common import in_arrow, table, texts_of

SPACE = "▁"
#: Entries of a worker's word cache (two generations of this many).
CACHE = 100_000
#: Words of more symbols take the queue instead of rounds: each round looks at a whole word.
LONG = 400

_NONE = np.int64(1) << 40


class PieceBPE:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        if sum(byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.eos, self.unknown = model.eos_id(), model.unk_id()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        whole = {p: i for i, p in enumerate(pieces)
                 if not (special[i] or byte[i] or model.is_unused(i))}
        scores = np.array([model.get_score(i) for i in range(size)])
        #: rank of a piece, equal for equal scores; 0 merges first
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        # Symbols: piece ids, then characters that occur in pieces only, then any other.
        symbols = dict(whole)
        for piece in whole:
            for char in piece:
                symbols.setdefault(char, size + len(symbols))
        self.base = size + len(symbols) + 1
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.base
        for name, k in symbols.items():
            if len(name) == 1:
                self.symbol_of[ord(name)] = k
        self.char_of = {k: name for name, k in symbols.items() if k >= size}
        self.size = size
        pairs = {}
        for piece, k in whole.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = k
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        inner = any(SPACE in p.lstrip(SPACE) for p in whole)
        line = any("\n" in p for p in whole)
        # Words end before a space, unless some piece goes on over one.
        body = f"[^{SPACE}]" if line else rf"[^{SPACE}\n]"
        self.words = re.compile("(?s).+" if inner else rf"{SPACE}*{body}+|{SPACE}+|\n")
        self.decimal = [str(i) for i in range(size)]
        self.bytes_of = [
            b"" if model.is_control(i) else b" \xe2\x81\x87 " if special[i]
            else bytes([self.byte_ids.index(i)]) if byte[i]
            else pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        self.is_byte = byte
        self.is_control = [model.is_control(i) for i in range(size)]
        self.fresh: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two symbols make, -1 if none; symbols outside the table make none."""
        ok = (left < self.base) & (right < self.base)
        key = np.where(ok, left * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)

    def _ranks(self, left: np.ndarray, right: np.ndarray, together: np.ndarray):
        made = np.where(together, self._merged(left, right), -1)
        return made, np.where(made >= 0, self.rank[made], _NONE)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; words have spaces already replaced and are independent."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.symbol_of[points]
        word = np.repeat(np.arange(len(words)), sizes)
        out: list = [None] * len(words)
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self._to_ids(self._queue(symbol[word == k].tolist()))
        if (sizes > LONG).any():
            short = sizes[word] <= LONG
            symbol, word = symbol[short], word[short]
        done_symbol, done_word = [], []
        last = np.r_[word[1:] != word[:-1], [True] * (len(word) > 0)].astype(bool)
        made, rank = self._ranks(symbol, np.r_[symbol[1:], symbol[:1]], ~last)
        while len(symbol):
            last = np.r_[word[1:] != word[:-1], True]
            start = np.flatnonzero(np.r_[True, last[:-1]])
            best = np.minimum.reduceat(rank, start)
            best = np.repeat(best, np.diff(np.r_[start, len(word)]))
            live = best < _NONE
            if not live.all():
                done_symbol.append(symbol[~live])
                done_word.append(word[~live])
                symbol, word, made, rank, best = (
                    x[live] for x in (symbol, word, made, rank, best))
                if not len(symbol):
                    break
            chosen = self._choose(symbol, word, made, rank == best, best)
            symbol[chosen] = made[chosen]
            stay = np.ones(len(symbol), bool)
            stay[chosen + 1] = False
            symbol, word, made, rank = symbol[stay], word[stay], made[stay], rank[stay]
            # Only pairs with a merged symbol change.
            place = chosen - np.arange(len(chosen))
            stale = np.r_[place, np.maximum(place - 1, 0)]
            after = np.minimum(stale + 1, len(symbol) - 1)
            together = (stale + 1 < len(symbol)) & (word[after] == word[stale])
            made[stale], rank[stale] = self._ranks(symbol[stale], symbol[after], together)
        if done_word:
            symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
            order = np.argsort(word, kind="stable")
            symbol, word = symbol[order], word[order]
            cuts = np.searchsorted(word, np.arange(len(words) + 1))
            plain = np.maximum.reduceat(symbol, start) < self.size if len(
                start := cuts[:-1][cuts[:-1] < cuts[1:]]) else []
            all_plain = dict(zip(word[start].tolist(), np.asarray(plain).tolist(), strict=True))
            for k, fine in all_plain.items():
                own = symbol[cuts[k]:cuts[k + 1]]
                out[k] = own.astype(np.int32) if fine else self._to_ids(own.tolist())
        empty = np.zeros(0, np.int32)
        return [empty if x is None else x for x in out]

    def _choose(self, symbol, word, made, candidate, best) -> np.ndarray:
        """Places to merge in this round, leftmost first and without overlap.

        All are merged at once where that equals merging one after the other. Where a
        merge makes a pair that is as good as the round's, that pair would come before
        the rest, so such a word merges its leftmost place only.
        """
        place = np.flatnonzero(candidate)
        head = np.r_[True, (np.diff(place) > 1) | (word[place[1:]] != word[place[:-1]])]
        run = np.repeat(place[head], np.diff(np.r_[np.flatnonzero(head), len(place)]))
        chosen = place[(place - run) % 2 == 0]
        n = len(symbol)
        new = made[chosen]
        after = np.minimum(chosen + 2, n - 1)
        right_ok = (chosen + 2 < n) & (word[after] == word[chosen])
        before = np.maximum(chosen - 1, 0)
        left_ok = (chosen > 0) & (word[before] == word[chosen])
        left = symbol[before]
        joined = np.r_[False, np.diff(chosen) == 2] & left_ok
        left = np.where(joined, np.r_[-1, new[:-1]], left)
        _, right_rank = self._ranks(new, symbol[after], right_ok)
        _, left_rank = self._ranks(left, new, left_ok)
        early = np.minimum(right_rank, left_rank) <= best[chosen]
        if early.any():
            single = np.isin(word[chosen], word[chosen[early]])
            leftmost = np.r_[True, word[chosen[1:]] != word[chosen[:-1]]]
            chosen = chosen[~single | leftmost]
        return chosen

    def _queue(self, symbol: list[int]) -> list[int]:
        """The same merges for one long word, by a queue of pairs."""
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, queue = [True] * n, []
        table = dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist(), strict=True))

        def push(i):
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and max(symbol[i], symbol[j]) < self.base:
                k = table.get(symbol[i] * self.base + symbol[j])
                if k is not None:
                    heapq.heappush(queue, (int(self.rank[k]), i, symbol[i], symbol[j], k))

        for i in range(n - 1):
            push(i)
        while queue:
            _, i, left, right, k = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], alive[j] = k, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [s for s, a in zip(symbol, alive, strict=True) if a]

    def _to_ids(self, symbols: list[int]) -> np.ndarray:
        """Symbols to ids; characters that are no piece become their bytes."""
        ids: list[int] = []
        for s in symbols:
            if s < self.size:
                ids.append(s)
            else:
                char = self.char_of.get(s) or chr(s - self.base)
                ids += [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return np.array(ids, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, the end id last."""
        cut = [self.words.findall((" " + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.fresh) > CACHE:
            self.fresh, self.aged = {}, self.fresh
        known, aged = self.fresh, self.aged
        new = []
        for word in {w for words in cut for w in words}.difference(known):
            if word in aged:
                known[word] = aged[word]
            else:
                new.append(word)
        known.update(zip(new, (x.tobytes() for x in self.encode_words(new)), strict=True))
        end = np.array([self.eos], np.int32).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, words)) + end, np.int32)
                for words in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control pieces vanish, the first piece loses the space put before it."""
        if not ids:
            return ""
        joined = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if self.bytes_of[i]), None)
        if first is not None and not self.is_byte[first] and first != self.unknown \
                and joined[:1] == b" ":
            joined = joined[1:]
        if any(map(self.is_control.__getitem__, ids[:-1])):  # it also ends a run of bytes
            parts = [b""]
            for i in ids:
                if self.is_control[i]:
                    parts.append(b"")
                else:
                    parts[-1] += self.bytes_of[i]
            whole = "".join(map(_lenient, parts))
            return whole[1:] if len(joined) < sum(map(len, parts)) else whole
        return _lenient(joined)


def _lenient(data: bytes) -> str:
    """UTF-8 with each byte that begins no character replaced on its own."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[:e.start].decode() + "�")
            data = data[e.start + 1:]
    return "".join(out)


@lru_cache(maxsize=2)
def piece_bpe(model_file: str) -> PieceBPE:
    return PieceBPE(model_file)


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, decoded) per document: ids with the end id, and the text they decode to.

    NULL texts count as empty: the end id alone, decoded to the empty text. Every row
    keeps its own row, in place; other columns are ignored. No shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        model = piece_bpe(model_file)

        def convert(batch):
            ids = model.encode(texts_of(batch))
            return pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                pa.array([model.decode(i.tolist()) for i in ids])], ["doc_id", "ids", "decoded"])
        return convert

    return in_arrow(docs.select("doc_id", "text"), make,
                    f"doc_id {kind}, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of ``encode_pieces``, made in the tasks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        from hashlib import sha256

        model = piece_bpe(model_file)

        def convert(batch):
            counts, of_ids, of_text = [], [], []
            for ids in model.encode(texts_of(batch)):
                ids = ids.tolist()
                counts.append(len(ids))
                joined = " ".join(map(model.decimal.__getitem__, ids))
                of_ids.append(sha256(joined.encode()).hexdigest())
                of_text.append(sha256(model.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return convert

    return in_arrow(docs.select("doc_id", "text"), make, (
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return piece_digests(table(spark, sf_dir, "documents"), default_model())
