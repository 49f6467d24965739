"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a batch (up to ENCODE_BYTES of text) are laid out as one row of symbols. An index maps
each adjacent pair that the vocabulary can merge to all its positions; the active
pair of lowest rank is taken, its occurrences are merged from left to right, and
the lists of the pairs that this makes or breaks are updated. One pass so encodes
all words of the batch. Spark deals out the texts; a word that a task has met
before is not encoded again (a bounded cache, dropped when full).

Defined cases. A null text is empty and has no ids. A very long text is encoded whole;
of equal pairs the leftmost merges first, as ranks alone order the others. Strings of special tokens in
a text become the special ids, as the vocabulary's file says. A null id is
returned as it is; repeated rows give repeated results; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .workspace import over_texts, type_of

#: Words whose encoding one task remembers; when there are more, it begins anew with the next batch.
CACHE_WORDS = 350_000
#: Rows and bytes of text that are encoded together.
ENCODE_ROWS, ENCODE_BYTES = 16_384, 12 << 20

#: Fixed pattern of the vocabulary's pre-tokenizer, for text of ASCII and the letters of Latin-1, lower-cased.
_LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")
#: What the plain path takes: ASCII without controls, white space, and the letters of Latin-1 (with its two signs).
_PLAIN = bytes([*range(9, 14), *range(0x20, 0x7F), *range(0xC0, 0x100)])


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(shifted)) for b in range(256)]


#: Marks among symbols: between words, merged into its neighbour, a byte that the vocabulary lacks. And the rank of no merge.
WALL, GONE, ABSENT, NO_RANK = -1, -2, -3, 1 << 40


class Vocabulary:
    """The model of a tokenizer file: symbols, ranks of merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, ids = path, model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        symbols = byte_symbols()
        self.inner = np.array([ids.get(c, ABSENT) for c in symbols], dtype=np.int32)
        self.final = np.array([ids.get(c + self.suffix, ABSENT) for c in symbols], dtype=np.int32)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.by_rank = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        first, second, merged = np.array(self.by_rank, dtype=np.int64).reshape(-1, 3).T
        ranks = np.arange(len(pairs))
        # Ascending order needs that no merge makes a pair of lower rank than its own, as in any vocabulary learned by merging.
        lowest = np.full(max(self.tokens, default=0) + 1, NO_RANK)
        np.minimum.at(lowest, np.concatenate([first, second]), np.concatenate([ranks, ranks]))
        if (lowest[merged] <= ranks).any():
            raise ValueError("a merge makes a pair that comes before it")
        keys = (first << 20) | second
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NO_RANK where the vocabulary has no merge; symbols below 0 have none."""
        key = (left.astype(np.int64) << 20) | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The ids of all words (bytes), by one pair occurrence index, and where the walls between them are.

        symbols holds all words in a row, with WALL before, between and after
        them. occurs maps a rank to arrays of the positions where its pair was seen.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        last = np.cumsum(sizes[sizes > 0]) - 1
        inner = self.inner[raw]
        inner[last] = self.final[raw[last]]
        symbols = np.full(len(raw) + len(words) + 1, WALL, dtype=np.int32)
        symbols[np.arange(len(raw)) + np.repeat(np.arange(1, len(words) + 1), sizes)] = inner
        symbols = symbols[symbols != ABSENT]
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)

        occurs: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(positions: np.ndarray, ranks: np.ndarray) -> None:
            found = ranks < NO_RANK
            if not found.any():
                return
            positions, ranks = positions[found], ranks[found]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for s, e in pairwise(starts):
                rank = int(ranks[s])
                if rank not in occurs:
                    occurs[rank] = []
                    heapq.heappush(heap, rank)
                occurs[rank].append(positions[s:e])

        index(np.arange(n - 1, dtype=np.int32), self._ranks(symbols[:-1], symbols[1:]))
        while heap:
            rank = heapq.heappop(heap)
            lists = occurs.pop(rank)
            a, b, merged = self.by_rank[rank]
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[symbols[at] == a]
            right = after[at]
            hit = symbols[right] == b
            at, right = at[hit], right[hit]
            if a == b and len(at) > 1:  # of overlapping pairs in a run, each second one
                keep, free = np.ones(len(at), dtype=bool), -1
                for k, (x, y) in enumerate(zip(at.tolist(), right.tolist())):
                    keep[k] = x != free
                    free = y if keep[k] else -1
                at, right = at[keep], right[keep]
            if not len(at):
                continue
            symbols[at], symbols[right] = merged, GONE
            beyond = after[right]
            after[at], before[beyond] = beyond, at
            ahead = before[at]
            index(np.concatenate([ahead, at]), self._ranks(np.concatenate([symbols[ahead], symbols[at]]), np.concatenate([symbols[at], symbols[beyond]])))
        ids = symbols[symbols != GONE]
        return ids, np.flatnonzero(ids == WALL).tolist()


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes texts; render turns the ids of a word into what the caller adds up (default: bytes of 32-bit ids)."""

    def __init__(self, path: str, render: Callable[[list[int]], object] | None = None):
        from tokenizers import Tokenizer

        self.vocabulary, self.render = Vocabulary(path), render
        whole = Tokenizer.from_file(path)
        # Only for text beyond the plain path: its rules for Unicode are the library's own.
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.splits = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.numbers, self.rendered = _Numbers(), []

    def _words(self, text: str) -> list:
        """Parts of a text: words free of white space, (words,) of byte symbols, or special ids."""
        if "<|" not in text and is_plain(text):
            return text.lower().split()
        parts: list = []
        for part in self.splits.split(text):
            if part in self.vocabulary.special:
                parts.append(self.vocabulary.special[part])
            elif is_plain(part):
                parts += part.lower().split()
            else:
                parts += [(piece,) for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return parts

    def encode(self, texts: list[str | None]) -> Iterator[list]:
        """For each text the rendered ids of its words. New words are encoded together, after all texts are split."""
        if len(self.numbers) > CACHE_WORDS:
            self.numbers, self.rendered = _Numbers(), []
        number = self.numbers.__getitem__
        rows = [array("i", map(number, self._words(t))) if t else () for t in texts]
        self._learn()
        rendered = self.rendered.__getitem__
        for row in rows:
            yield [*map(rendered, row)]

    def _learn(self) -> None:
        """Encodes the words that were numbered last."""
        todo, self.numbers.new = self.numbers.new, []
        split = [_LATIN_PIECES.findall(w) if isinstance(w, str) else [] if isinstance(w, int) else [w] for w in todo]
        pieces = list({p for ps in split for p in ps})
        ids, walls = self.vocabulary.encode_words([p.encode() if isinstance(p, str) else bytes(map(self.byte_of.__getitem__, p[0])) for p in pieces])
        if render := self.render:
            flat, unit = ids.tolist(), 1
        else:
            flat, unit, render = ids.astype("<u4").tobytes(), 4, lambda x: x
        spans = dict(zip(pieces, ((unit * (s + 1), unit * e) for s, e in pairwise(walls))))
        add = self.rendered.append
        for w, ps in zip(todo, split):
            if ps:
                s, e = spans[ps[0]]
                own = flat[s:e]
                for p in ps[1:]:
                    s, e = spans[p]
                    own = own + flat[s:e]
                add(render(own))
            else:
                add(render([w] if unit == 1 else w.to_bytes(4, "little")))


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """As the library's decode without a decoder: the tokens, joined by spaces; unknown ids are left out."""
    return " ".join(vocabulary.tokens[i] for i in ids if i in vocabulary.tokens)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for each row of docs."""

    def make():
        encoder = Encoder(path, lambda ids: ids)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [[x for word in words for x in word] for words in encoder.encode(batch.column(1).to_pylist())]
            decoded = [decode(encoder.vocabulary, x) for x in ids]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

        return work

    return over_texts(docs, ["doc_id", "text"], make, f"doc_id {type_of(docs, 'doc_id')}, ids array<int>, decoded string", ENCODE_ROWS, ENCODE_BYTES)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids as text and of the decoded text, made where the ids are."""

    def make():
        encoder = Encoder(path)
        tokens = encoder.vocabulary.tokens
        encoder.render = lambda ids: (len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]))
        sha = hashlib.sha256

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for words in encoder.encode(batch.column(1).to_pylist()):
                counts, ids, decoded = zip(*words) if words else ((), (), ())
                out.append((sum(counts), sha(" ".join(filter(None, ids)).encode()).hexdigest(), sha(" ".join(filter(None, decoded)).encode()).hexdigest()))
            n, a, b = zip(*out)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return over_texts(docs, ["doc_id", "text"], make, f"doc_id {type_of(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string", ENCODE_ROWS, ENCODE_BYTES)
