"""Whole texts to token ids with the tokenizers library, each distinct piece once."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are cut together, each of their distinct pieces once; and pieces that are put together at a time.
SLICE, RUN = 32 << 20, 1 << 18
#: Pieces that are encoded as one text, and texts that the library is given at once.
JOINED, AT_ONCE = 256, 64
#: White space, in whichever of the Unicode definitions.
WHITE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_made: dict[tuple[str, bool], PieceEncoder] = {}


def public_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: pa.Array, size: int = SLICE):
    """Runs of texts of about `size` bytes; a longer text is a run of its own. Yields first and past-last."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(lengths)
    k = 0
    while k < len(texts):
        n = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right")))
        yield k, n
        k = n


def runs(batches, size: int = SLICE):
    """Record batches put together to at least `size` bytes, so that what is done once for a run is done seldom."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Pieces:
    """Texts cut at each space between characters that aren't white space; there a pre-token always begins.

    distinct: the different pieces, each without the space before it. of: every piece as a number into distinct, but the first pieces of
    texts, which have no space before them, as len(distinct) plus the text's number. cuts: where each text's pieces begin, and the
    end. heads: the first pieces. Texts in which white space follows white space aren't cut: they are their own first piece. Null
    counts as the empty text."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        wide = pc.match_substring_regex(texts, WHITE + "{2}")
        lists = pc.split_pattern(pc.if_else(wide, "", texts), " ")
        self.cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        first = self.cuts[:-1]
        self.heads = pc.if_else(wide, texts, flat.take(pa.array(first))).to_pylist()
        coded = flat.dictionary_encode()
        self.distinct = coded.dictionary
        self.of = coded.indices.to_numpy().copy()
        self.of[first] = len(self.distinct) + np.arange(len(texts))

    def join(self, pool: np.ndarray, sizes: np.ndarray):
        """pool: numbers for each of distinct, then for each head, `sizes` of them. Yields those of each text, put together."""
        starts = np.cumsum(sizes) - sizes
        out, stops = [], [np.zeros(1, np.int64)]
        for k in range(0, len(self.of), RUN):
            part = self.of[k : k + RUN]
            n = sizes[part]
            ends = np.cumsum(n)
            out.append(pool[np.repeat(starts[part] - (ends - n), n) + np.arange(ends[-1])])
            stops.append(ends + stops[-1][-1])
        flat, at = np.concatenate(out) if out else pool[:0], np.concatenate(stops)[self.cuts].tolist()
        for a, b in zip(at, at[1:]):
            yield flat[a:b]


class PieceEncoder:
    """A byte-level BPE of the tokenizers library, applied to whole texts.

    Its pre-tokenizer always begins a new pre-token at a space between two characters that aren't white space, and merges never
    cross pre-tokens. So a text is cut at those spaces, each distinct piece of a slice is encoded once, and a text's ids are its
    pieces' ids in turn. Ids are little-endian, in 16 bits where the vocabulary allows, else 32. Null counts as the empty text, which
    has no ids.

    literal: the strings of special tokens are ordinary text; else they give the special ids, as the library does unless told otherwise.
    Special tokens that hold white space or draw it in aren't cut around: then texts are encoded whole."""

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = literal
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        added = self.library.get_added_tokens_decoder()
        self.cut = not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added.values())
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bytes = np.zeros(self.size, np.int64)  # of each id; a character of a token's string is one byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        for i, token in added.items():
            self.bytes[i] = len(token.content.encode())

    @classmethod
    def at(cls, path: str, literal: bool = False) -> PieceEncoder:
        """The one of this process."""
        return _made.get((path, literal)) or _made.setdefault((path, literal), cls(path, literal))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one text's after another's, and how many each has."""
        pools, sizes = [np.zeros(0, self.dtype)], np.zeros(len(texts), np.int64)
        for k in range(0, len(texts), AT_ONCE):
            # The library's results hold far more than ids: few of them at a time.
            ids = [x.ids for x in self.library.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]
            sizes[k : k + len(ids)] = list(map(len, ids))
            pools.append(np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes[k : k + len(ids)].sum())))
        return np.concatenate(pools), sizes

    def _spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces with a space before each. Many are encoded as one text, which their bytes divide again, as a token stands
        for certain bytes; not so pieces that end in white space, which would be drawn to the next one's space."""
        alone = pc.or_(pc.equal(pieces, ""), pc.match_substring_regex(pieces, WHITE + "$")).to_numpy(zero_copy_only=False)
        order = np.argsort(alone, kind="stable")
        texts = pieces.take(pa.array(order)).to_pylist()
        n = len(texts) - int(alone.sum())
        pool, _ = self._whole([" " + " ".join(texts[k : min(n, k + JOINED)]) for k in range(0, n, JOINED)])
        ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False)[order[:n]].astype(np.int64) + 1)
        stops = np.searchsorted(np.cumsum(self.bytes[pool]), ends) + 1
        more, few = self._whole([" " + x for x in texts[n:]])
        pool, sizes = np.concatenate([pool, more]), np.concatenate([np.diff(stops, prepend=0), few])
        back = np.empty(len(order), np.int64)  # in the order of pieces again
        back[order] = np.arange(len(order))
        starts, sizes = (np.cumsum(sizes) - sizes)[back], sizes[back]
        return pool[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(pool))], sizes

    def encode(self, texts: pa.Array):
        """Yields the ids of each text, as an array."""
        for a, b in slices(texts):
            if not self.cut:
                pool, sizes = self._whole(pc.fill_null(texts.slice(a, b - a), "").to_pylist())
                yield from np.split(pool, np.cumsum(sizes)[:-1])
                continue
            cut = Pieces(texts.slice(a, b - a))
            pool, sizes = self._spaced(cut.distinct)
            heads, few = self._whole(cut.heads)
            yield from cut.join(np.concatenate([pool, heads]), np.concatenate([sizes, few]))
