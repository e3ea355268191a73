"""Token ids in compressed files: a context-mixing range coder over independent, checksummed blocks.

A frame of many ids has symbols for its ids and for frequent pairs of neighbours, numbered by how frequent they are. What
follows speaks of ids and means these symbols; there a block is up to _BLOCK of them.

A block is up to BLOCK ids and starts from an empty model. For each id three models are mixed: the
id that followed the same two ids last time, the id that followed the same one (one follower a context),
and the frequencies of the block's ids as of the last of five refreshes, after 32, 128, 256, 512 and 1,024
ids; ids that were not in the block by then are coded by a fixed share each, falling with the id. The parts
of the code space that the models get are set every 64 ids by how often each was right, by how the last
order-2 prediction fared.
Coder and decoder run the same model, one step for many blocks at a time.

A frame holds consecutive documents: header, number of ids of each document, ids and pairs that have symbols, a
CRC-32 of all that, then for each block its number of symbols, length and CRC-32 of the symbols, and the code bytes. Frames are rows of a Parquet table, in document order.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import sys
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fringeflow.llm.store import materialize

BLOCK, LANES, END = 2048, 4096, 2
MAGIC = b"FFTK2\0"
#: Ids after which a block's order-0 table is made anew.
_REBUILD = (32, 128, 256, 512, 1024)  # powers of two
_SLOTS, _NONE, _GROUP = 2048, 0xFFFF, 8
_ORDER2, _ORDER1, _ORDER0, _ESCAPE = range(4)
_TOTAL, _REGISTER, _LEAST = 1 << 16, (1 << 48) - 1, 1 << 32
#: Ids after which the models' shares are set anew: each _ADAPT, and the first ones.
_ADAPT, _SOON = 64, (16, 32)
#: Bits of the code space of ids that are new in a block.
_NEW_BITS = 20
#: Ids from which on a frame has symbols for frequent pairs of neighbours; pairs at most, how often one is there at least.
_JOINED, _PAIRS, _OFTEN = 1 << 17, 16_000, 48
#: Symbols of a block where pairs have some, so that a task has as many blocks at once as before.
_BLOCK = 1024
#: Of the hash table of pairs: bits, multiplier, ids that are joined at once.
_TABLE_BITS, _SPREAD, _PORTION = 18, np.uint32(0x9E3779B1), 1 << 18
#: Words after which a worker lets those go that it has not met again.
_REMEMBERED = 400_000
#: Words that the library gets together.
_ASKED = 1000
#: Bytes of texts that are cut together.
_AT_ONCE = 8 << 20
#: The settings of the tokenizers whose cuts _CUT reproduces (byte-level, GPT-2's pattern).
_PRE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PLAIN = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False}
#: That pattern for texts of Latin letters, ASCII digits and signs; other characters are left out, so that a text with any is told by its length.
_CUT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?'[!-/:-@\[-`{-~]*|[ \t\n\r]+(?!\S)|[ \t\n\r]+")
#: What is empty, has a blank at an end, or a character that _CUT leaves out.
_BLANK_OR_OTHER = r"^$|^[\t\n\r]|[\t\n\r]$|[^A-Za-zÀ-ÖØ-öø-ɏ!-/:-@\[-`{-~0-9\t\n\r]"
#: What _CUT cuts into a word, and signs if there are any.
_WORD_AND_SIGNS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+)(?P<signs>(?:[!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)?)$"
#: How byte-level vocabularies write each byte: visible ones as they are, the others from U+0100 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLING = "".join(chr(b if b in _VISIBLE else 256 + sum(x not in _VISIBLE for x in range(b))) for b in range(256))


class Encoder:
    """Ids of texts by the tokenizers library; remembers words, in bounded memory.

    Where the tokenizer is of the kind that _CUT reproduces and a text has only characters that it knows,
    the text is cut here and the library's model gets each different word once. Any other tokenizer or
    text, and a text that spells an added token, goes to the library whole. Of many texts, what stands
    between two spaces is cut once, however often it is there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if max(self.tokenizer.get_vocab().values()) >= _NONE:
            raise ValueError("ids must be below 65535")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.bare = Tokenizer(self.model)
        self.spells = np.zeros(_NONE, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.spells[i] = len(token)
        kind = json.loads(self.tokenizer.to_str())
        own = kind["model"]
        self.cuts = own["type"] == "BPE" and kind["normalizer"] is None and kind["truncation"] is None
        self.cuts &= _PRE.items() <= (kind["pre_tokenizer"] or {}).items() and all(own.get(k) == v for k, v in _PLAIN.items())
        self.words = _Words(self.word)
        self.met, self.ids_met = pa.array([], pa.string()), pa.array([], pa.binary())  # what stood between two spaces
        self.last_met, self.turn = np.zeros(0, np.int64), 0

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2").tobytes()  # without offsets

    def word(self, word: str) -> bytes:
        """Ids of what the tokenizer cuts into tokens only."""
        own = word.lstrip(" ")
        if own.isascii() and own.isalnum():  # spelled as they are
            spelled = word.replace(" ", _SPELLING[32])
        else:
            spelled = charmap_decode(word.encode(), "strict", _SPELLING)[0]
        found = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(found)}H", *found)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u2")
        words = _CUT.findall(text) if self.cuts else ()
        if sum(map(len, words)) != len(text) or any(t in text for t in self.added):
            return np.frombuffer(self.ids(text), "<u2")
        self.forget()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u2")

    def forget(self) -> None:
        if len(self.words) > _REMEMBERED:
            self.words.before = {}
            self.words = _Words(self.word, self.words)
        if len(self.met) > _REMEMBERED:
            keep = np.sort(np.argsort(-self.last_met, kind="stable")[: _REMEMBERED // 2])
            self.met, self.ids_met, self.last_met = self.met.take(pa.array(keep)), self.ids_met.take(pa.array(keep)), self.last_met[keep]

    def asked(self, words: bytes) -> pa.Array:
        """Ids of words (with a zero between two), which the library gets together; as many tokens are a word's as spell it."""
        spelled = charmap_decode(words, "strict", _SPELLING)[0].split(_SPELLING[0])
        got = self.bare.encode_batch_fast([spelled[k : k + _ASKED] for k in range(0, len(spelled), _ASKED)], is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u2") for x in got])
        end, until = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled))), np.cumsum(self.spells[ids])
        last = np.searchsorted(until, end)
        if not len(ids) or until[-1] != end[-1] or (until[last] != end).any():  # the vocabulary leaves some byte out
            return pa.array([self.word(w) for w in words.decode().split("\0")], pa.binary())
        return pa.Array.from_buffers(pa.binary(), len(spelled), [None, pa.py_buffer(np.append(0, 2 * last + 2).astype(np.int32)), pa.py_buffer(ids)])

    def pieces(self, texts: pa.Array) -> pa.Array:
        """Ids of what stands between two spaces, with the one before it; null where its neighbours or the library must be asked.

        A word of _CUT has a space at its start or among blanks only, so that what has no blank at its ends
        is cut alone as it is in its text. Most are a word and signs: words that were met with other signs
        are known, the others go to the library.
        """
        both = pc.extract_regex(texts, _WORD_AND_SIGNS)
        plain = both.is_valid().to_numpy(zero_copy_only=False)
        both = both.drop_null()
        word, signs = (pc.struct_field(both, k).dictionary_encode() for k in ("word", "signs"))
        at = np.full(len(word.dictionary), -1)
        known = pc.index_in(self.met, word.dictionary)  # a table of the fewer
        at[known.drop_null().to_numpy()] = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        of, new = self.ids_met, np.flatnonzero(at < 0)
        at[new] = len(self.met) + np.arange(len(new))
        if len(new):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), word.dictionary.take(pa.array(new))), "\0 ")
            of = pa.concat_arrays([of, self.asked(b" " + joined[0].as_buffer().to_pybytes())])
        of = of.take(pa.array(at)).take(word.indices)
        ends = pa.array([self.words[x] if x else b"" for x in signs.dictionary.to_pylist()], pa.binary()).take(signs.indices)
        of = pc.binary_join_element_wise(of, ends, pa.scalar(b"", pa.binary()))
        odd = np.flatnonzero(~plain)
        order = np.empty(len(texts), np.int64)
        order[plain], order[odd] = np.arange(len(both)), len(both) + np.arange(len(odd))
        return pa.concat_arrays([of, self.odd(texts.take(pa.array(odd)), " ")]).take(pa.array(order))

    def odd(self, texts: pa.Array, before: str) -> pa.Array:
        other = pc.match_substring_regex(texts, _BLANK_OR_OTHER).to_pylist()
        cuts = [None if a else _CUT.findall(before + x) for a, x in zip(other, texts.to_pylist(), strict=True)]
        new = [w for w in {w for cut in cuts if cut for w in cut} if w not in self.words and w not in self.words.before]
        if new:
            self.words.update(zip(new, self.asked("\0".join(new).encode()).to_pylist(), strict=True))
        get = self.words.__getitem__
        return pa.array([None if cut is None else b"".join(map(get, cut)) for cut in cuts], pa.binary())

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow column; none for null."""
        texts = pc.fill_null(texts, "")
        end, s = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while s < len(texts):
            e = max(s + 1, int(np.searchsorted(end, (end[s - 1] if s else 0) + _AT_ONCE, "right")))
            yield from self.together(texts[s:e]) if self.cuts else map(self, texts[s:e].to_pylist())
            s = e

    def together(self, texts: pa.Array) -> Iterator[np.ndarray]:
        self.forget()
        pieces = pc.split_pattern(texts, " ")
        at = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        flat = pieces.flatten()
        before = len(self.met)
        coded = pa.concat_arrays([self.met, flat]).dictionary_encode()  # what was met keeps its place
        code, met = coded.indices.to_numpy()[before:].copy(), coded.dictionary
        first = flat.take(pa.array(at[:-1])).dictionary_encode()  # these have no space before them
        code[at[:-1]] = len(met) + first.indices.to_numpy()
        self.ids_met, self.met = pa.concat_arrays([self.ids_met, self.pieces(met[before:])]), met
        found = pa.concat_arrays([self.ids_met, self.odd(first.dictionary, "")])
        alone = np.logical_or.reduceat(found.is_null().to_numpy(zero_copy_only=False)[code], at[:-1])
        for t in self.added:
            alone |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        coded = found.cast(pa.large_binary()).take(pa.array(code))
        ends = np.frombuffer(coded.buffers()[1], np.int64)[at] // 2
        ids = np.frombuffer(coded.buffers()[2] or b"", "<u2")
        self.turn += 1
        self.last_met = np.append(self.last_met, np.zeros(len(met) - before, np.int64))
        self.last_met[code[code < len(met)]] = self.turn
        for k, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            yield self(texts[k].as_py()) if alone[k] else ids[s:e]


class _Words(dict):
    """Ids of words, found when they are first asked for, or taken from those of before."""

    def __init__(self, find, before: dict | None = None):
        self.find, self.before = find, {} if before is None else before

    def __missing__(self, word: str) -> bytes:
        got = self[word] = self.before.get(word) or self.find(word)
        return got


def encoder(path: str) -> Encoder:
    """The Encoder of a tokenizer's file, kept by the Python worker from task to task."""
    kept = vars(sys.modules.setdefault("_fringeflow_encoders", ModuleType("_fringeflow_encoders")))
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each id in a code space of 2**_NEW_BITS, and the id at each place: lower ids, which vocabularies make first, get more."""
    share = 1 / (np.arange(_NONE) + 256.0)
    end = np.floor(np.cumsum(share) / share.sum() * ((1 << _NEW_BITS) - _NONE)).astype(np.int64) + np.arange(1, _NONE + 1)
    size = np.diff(end, prepend=0)
    return end - size, size, np.repeat(np.arange(_NONE, dtype=np.uint16), size)


_NEW_START, _NEW_SIZE, _NEW_ID = _prior()


class _Model:
    """The state of many blocks at once; one that is done is dropped. Tables by block, mood and model or case have the blocks innermost."""

    def __init__(self, lanes: int, longest: int):
        n = self.n = self.lanes = lanes
        self.next1, self.next2 = (np.full(n * _SLOTS, _NONE, np.uint16) for _ in range(2))
        self.right = np.empty((4, 3, n), np.int64)  # by model, mood and block
        self.right[:] = np.array([4, 4, 24, 32])[:, None, None]
        self.past, self.met = np.zeros((longest, n), np.uint16), np.zeros((_ADAPT, n), np.int8)
        self.hash, self.hash_before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.lane = np.arange(n)
        self.mood = np.zeros(n, np.int8)
        self.shift = None  # no order-0 table yet
        self.share()

    def keep(self, m: int) -> None:
        """Only the first m blocks go on."""
        self.n = m
        self.lane, self.hash, self.hash_before, self.mood = self.lane[:m], self.hash[:m], self.hash_before[:m], self.mood[:m]

    def share(self) -> None:
        """Where each model's share of the code space ends, by which of the two contexts foretell an id, mood and block."""
        self.shares = np.empty((4, 3, self.lanes), np.int64)
        w2, w1, w0, new = self.right.astype(np.float64)
        rest = new if self.shift is None else w0 + new
        for case in range(4):
            unit = (_TOTAL - 8192) / (rest + w2 * (case & 1) + w1 * (case >> 1))
            end = (w2 * unit).astype(np.int64) if case & 1 else 0
            ends = end
            if case >> 1:
                end = end + (w1 * unit).astype(np.int64)
            ends = ends | end << 16
            if self.shift is not None:
                end = end + (w0 * unit).astype(np.int64) + 8128
            self.shares[case] = ends | end << 32
        self.shares = self.shares.ravel()

    def predict(self) -> None:
        """Ids that the two contexts foretell, and the ends of the models' shares, 16 bits each."""
        self.slot1 = (self.hash & (_SLOTS - 1)) * self.lanes + self.lane  # what follows frequent ids is side by side for all blocks
        self.slot2 = (self.hash * 3 + self.hash_before & (_SLOTS - 1)) * self.lanes + self.lane
        self.p1, self.p2 = self.next1.take(self.slot1, mode="wrap"), self.next2.take(self.slot2, mode="wrap")
        self.has2 = self.p2 != _NONE
        case = self.has2.view(np.int8) + (((self.p1 != _NONE) & (self.p1 != self.p2)).view(np.int8) << 1)
        self.ends = self.shares.take((3 * case + self.mood).astype(np.int64) * self.lanes + self.lane)

    def space(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the share of each block's model."""
        at = who.astype(np.int64) << 4
        start = self.ends << 16 >> at & 0xFFFF
        return start, ((self.ends >> at) - start - 1 & 0xFFFF) + 1

    def learn(self, t: int, ids: np.ndarray, who: np.ndarray) -> None:
        """After step t: ids (16 bits) and the models that had them."""
        n = self.n
        self.next1[self.slot1] = ids
        self.next2[self.slot2] = ids
        self.past[t, :n] = ids
        self.met[t % _ADAPT, :n] = 4 * self.mood + who
        self.mood = self.has2.view(np.int8) + (who == _ORDER2).view(np.int8)
        self.hash_before, self.hash = self.hash, ids.astype(np.int64) * 40503 >> 4
        done = t + 1
        if done in _REBUILD and done < len(self.past):
            self.count(done)
        if done % _ADAPT == 0 or done in _SOON:
            since = max([k for k in (0, *_SOON) if k < done] + [done - _ADAPT])
            met = self.met[since % _ADAPT : t % _ADAPT + 1, :n]
            for case in range(12):
                right = self.right[case & 3, case >> 2, :n]
                right += 24 * np.add.reduce((met == case).view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64) + 1
                right >>= 1
            self.share()

    def count(self, done: int) -> None:
        """A new order-0 table. An entry: id, number of ids before it in order, how often it was there, 16 bits each."""
        rows = np.sort(np.ascontiguousarray(self.past[:done, : self.n].T), axis=1).astype(np.int32)
        flat = (rows | (self.lane << 16).astype(np.int32)[:, None]).ravel()
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        self.keys = flat[first]
        self.often = np.diff(np.r_[first, len(flat)])
        self.entry = (self.keys & 0xFFFF).astype(np.int64) | (first & done - 1) << 16 | self.often << 32
        self.shift = done.bit_length() - 1

    def entries(self, ids: np.ndarray) -> np.ndarray:
        """Entries of ids (blocks by steps) in the order-0 table, 0 for those it does not have; as steps by blocks."""
        out = np.zeros(ids.shape[::-1], np.int64)
        if self.shift is None:
            return out
        dense = np.zeros(_GROUP << 16, np.int64)
        cut = np.searchsorted(self.keys, np.arange(0, self.n + _GROUP, _GROUP, dtype=np.int32) << 16)
        for g in range(0, self.n, _GROUP):  # a few blocks at a time, so that the dense table stays small
            s, e = cut[g // _GROUP], cut[g // _GROUP + 1]
            own = self.keys[s:e] - (g << 16)
            dense[own] = self.entry[s:e]
            lanes = ids[g : g + _GROUP]
            out[:, g : g + _GROUP] = dense[lanes + (np.arange(len(lanes)) << 16)[:, None]].T
            dense[own] = 0
        return out

    def within(self, entry: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order-0 entry's part of the share (start, size)."""
        cum = entry >> 16 & 0xFFFF
        low = cum * size >> self.shift
        return start + low, ((cum + (entry >> 32)) * size >> self.shift) - low


# A range coder with 48-bit ranges, of which 16 bits pass on at once: as a model's part is a 65536th at least,
# a range of 32 bits or more needs one such move after it, or none; a new id's part may be less, and needs up to two.


def _plan(counts: list[int]) -> tuple[list[int], np.ndarray]:
    """Blocks from the longest on, and how many go on at each step."""
    order = sorted(range(len(counts)), key=lambda i: -counts[i])
    sizes = np.array([counts[i] for i in order], np.int64)
    return order, np.searchsorted(-sizes, -np.arange(max(counts, default=0)))


def _turned(grid: np.ndarray) -> np.ndarray:
    """The transposed array, copied in stripes that caches hold."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for k in range(0, len(grid), 64):
        out[:, k : k + 64] = grid[k : k + 64].T
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The code bytes of each block of at most BLOCK ids."""
    order, going = _plan([len(b) for b in blocks])
    n = len(order)
    text = np.zeros((n, len(going)), np.uint16)
    for k, i in enumerate(order):
        text[k, : len(blocks[i])] = blocks[i]
    grid = _turned(text)
    model = _Model(n, len(going))
    low, size = np.zeros(n, np.int64), np.full(n, _REGISTER, np.int64)
    width = len(going) + 3 * _ADAPT + 4  # words of a block, for now
    out, at = np.zeros(n * width, np.uint32), np.arange(n) * width  # words of 16 bits and a carry; a word that has not moved on is written over

    def move(lanes: np.ndarray) -> None:
        x = low[lanes]
        out[at[lanes]] = x >> 32
        low[lanes] = (x & 0xFFFFFFFF) << 16
        size[lanes] <<= 16
        at[lanes] += 1

    for t, m in enumerate(going.tolist()):
        if m < model.n:
            model.keep(m)
        ids = grid[t, :m]
        if t in (0, *_REBUILD):
            first = t
            entries = model.entries(text[:m, t : next((k for k in _REBUILD if k > t), None)])
            beyond = np.where(entries > 0, np.int8(_ORDER0 - _ORDER1), np.int8(_ESCAPE - _ORDER1))
        if t % _ADAPT == 0 and (most := int((at - np.arange(n) * width).max())) + 3 * _ADAPT + 4 > width:
            wider = np.zeros((n, width + len(going)), np.uint32)
            wider[:, :most] = out.reshape(n, width)[:, :most]
            at += np.arange(n) * len(going)
            out, width = wider.ravel(), width + len(going)
        model.predict()
        who = (model.p2 != ids).view(np.int8) * (_ORDER1 + (model.p1 != ids).view(np.int8) * beyond[t - first, :m])
        start, part = model.space(who)
        if model.shift is not None:
            start, part = model.within(np.where(who == _ORDER0, entries[t - first, :m], 1 << 32 + model.shift), start, part)
        l, z = low[:m], size[:m]
        unit = z >> 16
        l += start * unit
        np.multiply(unit, part, out=z)
        moves = (z < _LEAST).astype(np.int64)
        word, by = l >> 32, moves << 4
        out[at[:m]] = word.astype(np.uint32)
        l -= word * moves << 32
        l <<= by
        z <<= by
        at[:m] += moves
        spelled = np.flatnonzero(who == _ESCAPE)
        if len(spelled):
            unit, new = size[spelled] >> _NEW_BITS, ids[spelled]
            low[spelled] += _NEW_START[new] * unit
            size[spelled] = unit = _NEW_SIZE[new] * unit
            spelled = spelled[unit < _LEAST]
            move(spelled)
            move(spelled[size[spelled] < _LEAST])
        model.learn(t, ids, who)
    for k in (32, 16, 0):
        out[at] = low >> k & (0x1FFFF if k == 32 else 0xFFFF)
        at += 1
    at -= np.arange(n) * width
    out = np.ascontiguousarray(out.reshape(n, width)[:, : int(at.max(initial=0))]).ravel()
    while len(carry := np.flatnonzero(out > 0xFFFF)):
        out[carry] &= 0xFFFF
        out[carry - 1] += 1
    words, done = out.astype("<u2").reshape(n, -1), [b""] * n
    for k, i in enumerate(order):
        done[i] = words[k, : at[k]].tobytes()
    return done


def decode_blocks(codes: list[bytes], counts: list[int]) -> list[np.ndarray]:
    order, going = _plan(counts)
    n = len(order)
    data = np.zeros((n, max(map(len, codes), default=0) // 2 + 8), "<u2")
    for k, i in enumerate(order):
        data[k, : len(codes[i]) // 2] = np.frombuffer(codes[i], "<u2")
    model = _Model(n, len(going))
    code = data[:, :3].astype(np.int64) @ (1 << np.array([32, 16, 0]))
    size, at = np.full(n, _REGISTER, np.int64), np.arange(n) * data.shape[1] + 3
    data, expanded = data.ravel(), None

    def move(lanes: np.ndarray) -> None:
        own = at[lanes]
        code[lanes] = code[lanes] << 16 | data.take(own, mode="clip")
        size[lanes] <<= 16
        at[lanes] = own + 1

    for t, m in enumerate(going.tolist()):
        if m < model.n:
            model.keep(m)
        if t in _REBUILD:
            expanded = np.repeat(model.entry, model.often)  # an entry for each id counted
        model.predict()
        ends, unit = model.ends, size[:m] >> 16
        target = np.minimum((code[:m] / unit).astype(np.int64), _TOTAL - 1)  # exact: both are below 2**48
        two, one = target < (ends & 0xFFFF), target < (ends >> 16 & 0xFFFF)
        who = _ESCAPE - (two.view(np.int8) + one.view(np.int8) + (target < ends >> 32).view(np.int8))
        start, width = model.space(who)
        ids = np.where(two, model.p2, model.p1)
        known = np.flatnonzero(who == _ORDER0)
        if len(known):
            s, w = start[known], width[known]
            u = ((((target[known] - s + 1) << model.shift) - 1) / w).astype(np.int64)
            entry = expanded.take((known << model.shift) + u)
            ids[known] = entry.astype(np.uint16)
            start[known], width[known] = model.within(entry, s, w)
        c, z = code[:m], size[:m]
        c -= start * unit
        np.multiply(unit, width, out=z)
        moves = (z < _LEAST).astype(np.int64)
        by = moves << 4
        c <<= by
        c |= data.take(at[:m], mode="clip").astype(np.int64) * moves
        z <<= by
        at[:m] += moves
        spelled = np.flatnonzero(who == _ESCAPE)
        if len(spelled):
            unit = size[spelled] >> _NEW_BITS
            ids[spelled] = new = _NEW_ID[np.minimum((code[spelled] / unit).astype(np.int64), len(_NEW_ID) - 1)]
            code[spelled] -= _NEW_START[new] * unit
            size[spelled] = unit = _NEW_SIZE[new] * unit
            spelled = spelled[unit < _LEAST]
            move(spelled)
            move(spelled[size[spelled] < _LEAST])
        model.learn(t, ids, who)
    done = [np.zeros(0, np.uint16)] * n
    grid = _turned(model.past)
    for k, i in enumerate(order):
        done[i] = grid[k, : counts[i]].copy()
    return done


def _join(x: np.ndarray, keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """With one symbol for each pair of neighbours in a hash table of pairs; the left of two that overlap."""
    key = x[:-1].astype(np.uint32) << 16 | x[1:]
    slot = key * _SPREAD >> 32 - _TABLE_BITS
    at = np.flatnonzero(keys.take(slot) == key)
    place = np.arange(len(at))
    run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
    at = at[(place - run) & 1 == 0]
    out, keep = x.copy(), np.ones(len(x), bool)
    out[at], keep[at + 1] = symbols.take(slot[at]), False
    return out[keep]


def _joined(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids as symbols, 0 the most frequent: (symbols, the ids, the pairs, the order of both). Parts of a pair are places among the ids.

    Pairs are chosen by counts on up to a million places of the frame; that decides how small it gets, not what is in it.
    """
    there = np.zeros(_NONE + 1, bool)
    there[ids] = True
    base, free = np.flatnonzero(there), np.flatnonzero(~there[:_NONE])
    step = (len(ids) >> 20) + 1
    seen = np.sort(ids[:-1:step].astype(np.uint32) << 16 | ids[1::step])
    first = np.flatnonzero(np.diff(seen, prepend=seen[0] ^ 1) != 0)
    often = np.diff(first, append=len(seen))
    best = np.argsort(-often, kind="stable")[: min(_PAIRS, len(free))]
    pair = seen[first[best[often[best] * step >= _OFTEN]]]
    slot = pair * _SPREAD >> 32 - _TABLE_BITS
    own = np.sort(np.unique(slot, return_index=True)[1])  # the most frequent of a slot
    pair, slot, new = pair[own], slot[own], free[: len(own)]
    keys, symbols = np.full(1 << _TABLE_BITS, 0xFFFFFFFF, np.uint32), np.zeros(1 << _TABLE_BITS, np.uint16)
    keys[slot], symbols[slot] = pair, new
    x = np.concatenate([_join(ids[s : s + _PORTION], keys, symbols) for s in range(0, len(ids), _PORTION)])
    value = np.concatenate([base, new])
    order = np.argsort(-np.bincount(x, minlength=_NONE + 1)[value], kind="stable")
    rank = np.zeros(_NONE + 1, np.uint16)
    rank[value[order]] = np.arange(len(order))
    return rank.take(x), base, np.searchsorted(base, np.stack([pair >> 16, pair & 0xFFFF], axis=1)), order


def _spelled(base: np.ndarray, pairs: np.ndarray, order: np.ndarray) -> pa.Array:
    """The ids of each symbol."""
    base = base.astype("<u2").tobytes()
    out = [base[k : k + 2] for k in range(0, len(base), 2)]
    for left, right in pairs.tolist():
        out.append(out[left] + out[right])
    return pa.array(out, pa.large_binary()).take(pa.array(order))


def write_frame(docs: list[np.ndarray]) -> bytes:
    """One frame of whole documents (arrays of 16-bit ids)."""
    symbols = np.concatenate(docs) if docs else np.zeros(0, "<u2")
    base = pairs = order = np.zeros(0, np.int64)
    if len(symbols) >= _JOINED:
        symbols, base, pairs, order = _joined(symbols)
    block = _BLOCK if len(base) else BLOCK
    blocks = [symbols[s : s + block] for s in range(0, len(symbols), block)]
    codes = [c for s in range(0, len(blocks), LANES) for c in encode_blocks(blocks[s : s + LANES])]
    head = struct.pack("<IIII", len(docs), len(blocks), len(base), len(pairs)) + np.array([len(d) for d in docs], "<u8").tobytes()
    head += b"".join(x.astype("<u2").tobytes() for x in (base, pairs, order))
    table = b"".join(struct.pack("<III", len(b), len(c), zlib.crc32(b.astype("<u2").tobytes())) for b, c in zip(blocks, codes, strict=True))
    return MAGIC + head + struct.pack("<I", zlib.crc32(head)) + table + b"".join(codes)


def read_frame(frame: bytes) -> list[np.ndarray]:
    """The documents of a frame; fails where its head or a block does not have its checksum."""
    if frame[: len(MAGIC)] != MAGIC:
        raise ValueError("not a frame of token ids")
    at = len(MAGIC) + 16
    n, k, singles, joined = struct.unpack_from("<IIII", frame, len(MAGIC))
    end = at + 8 * n + 2 * (singles + 2 * joined + singles + joined)
    if len(frame) < end + 4 or zlib.crc32(frame[len(MAGIC) : end]) != struct.unpack_from("<I", frame, end)[0]:
        raise ValueError("the head does not have its checksum")
    lengths = np.frombuffer(frame, "<u8", n, at).astype(np.int64)
    base, pairs, order = np.split(np.frombuffer(frame, "<u2", 2 * singles + 3 * joined, at + 8 * n), [singles, singles + 2 * joined])
    at = end + 4
    table = [struct.unpack_from("<III", frame, at + 12 * i) for i in range(k)]
    at += 12 * k
    codes = []
    for _, size, _ in table:
        codes.append(frame[at : at + size])
        at += size
    counts = [c for c, _, _ in table]
    blocks = [b for s in range(0, k, LANES) for b in decode_blocks(codes[s : s + LANES], counts[s : s + LANES])]
    for i, (b, (_, _, crc)) in enumerate(zip(blocks, table, strict=True)):
        if zlib.crc32(b.astype("<u2").tobytes()) != crc:
            raise ValueError(f"block {i} does not have its checksum")
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.uint16)
    if singles:
        ids = np.frombuffer(_spelled(base, pairs.reshape(-1, 2), order).take(pa.array(ids)).buffers()[2], "<u2")[: lengths.sum()]
    return np.split(ids, np.cumsum(lengths)[:-1]) if n else []


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode with the tokenizers library, whatever kind the file's tokenizer is (added tokens that a text spells become their ids, as the library has it), append END to each document, and write frames in ascending order of ids (null first, ties by text).

    Returns the written table: part, frame (their order is the documents'), doc_ids, n_ids, data.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    kind = pa.list_(pa.from_numpy_dtype(np.int64)) if dict(docs.dtypes)[id_col] == "bigint" else None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, frame = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, held, n = [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([ids], kind) if kind else pa.array([ids]), pa.array([n], pa.int64()), pa.array([write_frame(held)], pa.binary())], ["part", "frame", "doc_ids", "n_ids", "data"])

        gc.disable()  # nothing here makes cycles, and each collection would look through what is remembered
        try:
            for b in batches:
                for i, x in zip(b.column(0).to_pylist(), words.many(b.column(1)), strict=True):
                    x = np.append(x, np.uint16(END))
                    if held and n + len(x) > BLOCK * LANES:
                        yield made()
                        frame, ids, held, n = frame + 1, [], [], 0
                    ids.append(i)
                    held.append(x)
                    n += len(x)
            if held:
                yield made()
        finally:
            gc.enable()

    return materialize(rows.mapInArrow(encode, f"part int, frame int, doc_ids array<{dict(docs.dtypes)[id_col]}>, n_ids long, data binary"), "tokens")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in files of write(): start counts the ids of all documents before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "frame", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("own")).join(F.broadcast(per_part), "part")
    starts = starts.select("part", "frame", (F.col("offset") + F.col("own")).alias("start"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, frame, ids, data in zip(*(b.column(c).to_pylist() for c in ("part", "frame", "doc_ids", "data")), strict=True):
                docs = read_frame(data)
                sizes = np.array([len(d) for d in docs], np.int64)
                crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                cols = [pa.array(np.full(len(docs), part), pa.int32()), pa.array(np.full(len(docs), frame), pa.int32()), pa.array(ids, b.schema.field("doc_ids").type.value_type), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "frame", "doc_id", "within", "n_tokens", "ids_crc32"])

    docs = files.select("part", "frame", "doc_ids", "data").mapInArrow(decode, f"part int, frame int, doc_id {kind}, within long, n_tokens long, ids_crc32 long")
    out = docs.join(starts, ["part", "frame"])
    return out.select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
