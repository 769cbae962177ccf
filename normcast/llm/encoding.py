"""Whole-text token ids from the files of public tokenizers, with the ids of repeated chunks kept in memory."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The code points with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = "".join(c for c in WHITE_SPACE if c not in " \n")
#: Texts with such white space, doubled or at an end, are cut by _CHUNK and not at each single space and line end.
_IRREGULAR = f"[{_ODD}\x00]|[ \n][ \n]|\\A[ \n]|[ \n]\\z"
_CHUNK = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
#: ASCII and letters whose class, case and normal form are beyond doubt.
_PLAIN = "\\A[ \n][!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+\\z"
#: The first character of a key whose chunk has no space before it.
_BARE = "\x00"
#: Bytes of the longest chunk whose ids are kept.
_LONGEST = 64


class Encoder:
    """Exact token ids of whole texts, as the tokenizers library gives them.

    A text is cut at single spaces and line ends between other characters, where no token of either
    kind of vocabulary (byte-level with spaces, or words with white space dropped) can cross. Each
    distinct chunk goes through the library once, many at a time, and chunks of at most ``_LONGEST``
    bytes are kept with their ids, ``keep`` of them; when there are more, those met again stay. A chunk that
    has been let go is encoded again, so ids never depend on the bound. Texts that hold a special token's string
    go through the library whole, which gives that token's id; with ``special_as_text`` such strings
    are ordinary text.
    """

    def __init__(self, path: str, keep: int = 300_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each Spark task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self._special = "(?i)" + "|".join(map(re.escape, added)) if added else None
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        end = getattr(self.library.model, "end_of_word_suffix", None)
        self.words_only = end is not None
        self._n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self._n_bytes[i] = len(token) - (len(end) if end and token.endswith(end) else 0)
        self._known, self._known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self._met = np.zeros(0, np.int64)
        self._keep = keep

    def _alone(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes() if chunk else b""

    def _binaries(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * self.dtype.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])

    def _together(self, pieces: pa.Array, bare: np.ndarray) -> pa.Array:
        """Ids of plain chunks, each after one white character, in one call: tokens keep the bytes' order, so
        byte counts give the bounds. A bare chunk's white character is no part of it."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        joined = pieces.buffers()[2][offsets[0] : offsets[-1]].to_pybytes().decode()
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
        ends = offsets[1:] - offsets[0] - (np.arange(1, len(pieces) + 1) if self.words_only else 0)
        reached = np.cumsum(self._n_bytes[ids])
        last = np.searchsorted(reached, ends)
        if len(reached) == 0 or reached[-1] != ends[-1] or (reached[last] != ends).any():
            return pa.array([self._alone(c[1:] if b else c) for c, b in zip(pieces.to_pylist(), bare)], pa.large_binary())
        bounds = np.concatenate([[0], last + 1])
        if not self.words_only and bare.any():
            ids = np.delete(ids, bounds[:-1][bare])  # a bare chunk's line end is a token of its own
            bounds = bounds - np.concatenate([[0], np.cumsum(bare)])
        return self._binaries(ids, bounds)

    def _fresh(self, keys: pa.Array) -> pa.Array:
        """Ids of chunks through the library, in order."""
        bare = pc.starts_with(keys, _BARE)
        body = pc.if_else(bare, pc.utf8_slice_codeunits(keys, 1), keys)
        line = pc.and_not(pc.starts_with(body, "\n"), bare)
        pieces = pc.binary_join_element_wise(pc.if_else(bare, "\n", pc.if_else(line, "", " ")).cast(pa.large_string()), body, pa.scalar("", pa.large_string()))
        # a bare chunk may start with white space of its own, others hold it at their start alone
        plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False)
        bare, at = bare.to_numpy(zero_copy_only=False), np.flatnonzero(plain)
        out = [pa.array([], pa.large_binary())]
        for k in range(0, len(at), 20_000):
            some = at[k : k + 20_000]
            out.append(self._together(pieces.take(pa.array(some)), bare[some]))
        odd = np.flatnonzero(~plain)
        out.append(pa.array([self._alone(c[1:] if bare[i] else c) for i, c in zip(odd, pieces.take(pa.array(odd)).to_pylist())], pa.large_binary()))
        made = pa.concat_arrays(out)
        return made.take(pa.array(np.argsort(np.concatenate([at, odd]))))

    def _remember(self, keys: pa.Array, ids: pa.Array) -> None:
        short = pc.less_equal(pc.binary_length(keys), _LONGEST)
        keys, ids = keys.filter(short), ids.filter(short)
        if len(self._known) + len(keys) > self._keep:
            stay = np.argsort(-self._met, kind="stable")[: min(self._keep // 2, int((self._met > 0).sum()))]
            self._known, self._known_ids, self._met = self._known.take(pa.array(stay)), self._known_ids.take(pa.array(stay)), np.zeros(len(stay), np.int64)
            keys, ids = keys[: self._keep // 2], ids[: self._keep // 2]
        self._known, self._known_ids = pa.concat_arrays([self._known, keys]), pa.concat_arrays([self._known_ids, ids])
        self._met = np.concatenate([self._met, np.zeros(len(keys), np.int64)])

    def _gathered(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = lists.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self._known)
        lacking = pc.is_null(at)
        at, new = pc.fill_null(at, 0).to_numpy().astype(np.int64), lacking.to_numpy(zero_copy_only=False)
        self._met[at[~new]] += 1
        pool = self._known_ids
        if new.any():
            keys = coded.dictionary.filter(lacking)
            fresh = self._fresh(keys)
            at[new] = len(pool) + np.arange(len(keys))
            pool = pa.concat_arrays([pool, fresh])
            self._remember(keys, fresh)
        taken = pool.take(pa.array(at[coded.indices.to_numpy()]))
        bounds = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] // self.dtype.itemsize
        offsets = lists.offsets.to_numpy()
        return bounds[offsets - offsets[0]], np.frombuffer(taken.buffers()[2] or b"", self.dtype)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(bounds, ids)``: text ``i`` has ``ids[bounds[i]:bounds[i + 1]]``; null and empty texts have none."""
        texts = whole(texts)
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, self.dtype)
        special = pc.match_substring_regex(texts, self._special).to_numpy(zero_copy_only=False) if self._special else np.zeros(len(texts), bool)
        if special.any():
            return self._beside_special(texts, special)
        odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~odd)) if odd.any() else texts
        bounds, ids = np.zeros(1, np.int64), np.zeros(0, self.dtype)
        if len(even):
            marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_BARE, pa.large_string()), even, pa.scalar("", pa.large_string())), "\n", " \n")
            bounds, ids = self._gathered(pc.split_pattern(marked, " "))
        if not odd.any():
            return bounds, ids
        keys = [[c[1:] if c[0] == " " and len(c) > 1 and c[1] not in WHITE_SPACE + _BARE else _BARE + c for c in _CHUNK.findall(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
        odd_bounds, odd_ids = self._gathered(pa.array(keys, pa.large_list(pa.large_string())))
        return merged(odd, bounds, ids, odd_bounds, odd_ids)

    def _beside_special(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds, ids = self.encode_batch(texts.filter(pa.array(~special)))
        found = [np.frombuffer(self._alone(t), self.dtype) for t in texts.filter(pa.array(special)).to_pylist()]
        return merged(special, bounds, ids, np.cumsum([0, *map(len, found)]), np.concatenate(found))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch(pa.array([text], pa.large_string()))[1]


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One encoder for each vocabulary of a Python worker, which keeps it from task to task."""
    return Encoder(path)


def merged(which: np.ndarray, bounds: np.ndarray, ids: np.ndarray, other_bounds: np.ndarray, other_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bounds, ids)`` of all texts, from those of the texts where ``which`` is false and those where it is true."""
    sizes = np.zeros(len(which), np.int64)
    sizes[~which], sizes[which] = np.diff(bounds), np.diff(other_bounds)
    place, out = np.repeat(which, sizes), np.empty(sizes.sum(), ids.dtype)
    out[~place], out[place] = ids, other_ids
    return np.concatenate([[0], np.cumsum(sizes)]), out


def whole(texts: pa.Array) -> pa.Array:
    """The texts, nulls empty, in buffers of their own: some kernels misread an array whose first offset isn't 0."""
    empty = pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(empty, pc.fill_null(texts.cast(pa.large_string()), ""), empty)


def in_slices(texts: pa.Array, most_bytes: int = 4 << 20):
    """Ranges ``(a, b)`` of rows with about ``most_bytes`` of text each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    which = (np.cumsum(sizes) - sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
