"""The coder against zlib on the same blocks, and tokenizers of other kinds than the one whose cuts are known."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from fringeflow.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    return [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]


def test_smaller_than_zlib_on_the_same_blocks():
    words = tokens.encoder(PATH)
    assert words.cuts
    ids = np.concatenate([np.append(words(t), np.uint16(2)) for t in texts()])
    blocks = [ids[s : s + tokens.BLOCK] for s in range(0, len(ids), tokens.BLOCK)]
    ours, zipped = sum(map(len, tokens.encode_blocks(blocks))), sum(len(zlib.compress(b.tobytes(), 9)) for b in blocks)
    assert ours < 0.93 * zipped


def test_all_texts_have_the_library_s_ids():
    fast, plain = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    for t in [*texts(), "naïve—dash’s it's  x", "a 'n' b!'s c ''d", "x \t y\r\n z  ", "½ cup ²", "tab\t\tend ", "'ve 'S 'll", " 'tis _a_ __", "\x0bvt \x0c ff"]:
        assert fast(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("change", ["lower", "whitespace", "prefix"])
def test_tokenizers_of_other_kinds_go_to_the_library(tmp_path, change):
    from tokenizers import normalizers, pre_tokenizers

    other = Tokenizer.from_file(PATH)
    if change == "lower":
        other.normalizer = normalizers.Lowercase()
    elif change == "whitespace":
        other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    else:
        other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    path = str(tmp_path / "other.json")
    other.save(path)
    fast = tokens.Encoder(path)
    assert not fast.cuts
    for t in ("Hello World it's", " two  spaces", "ABC.def"):
        assert fast(t).tolist() == other.encode(t, add_special_tokens=False).ids


def test_rare_ids_in_short_and_long_blocks():
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 65535, n).astype(np.uint16) for n in (1, 5, 700, 2048)] + [np.arange(65535 - 2048, 65535).astype(np.uint16)]
    back = tokens.decode_blocks(tokens.encode_blocks(blocks), [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))


ODD = [None, "", " ", "  ", "a  b", " a", "a ", "\n", "a\n b", "a \nb", "a\n\n b", "\n\n", "a \n \nb", "\nfoo bar", " \nfoo", "a\tb \tc", "x y<|endoftext|> z", "日本 語 a b", "½ cup ²", "a\xa0b c", "it's 'n' b!'s d''d x", "x\r\ny z"]


def test_texts_together_have_the_library_s_ids(monkeypatch):
    plain, column = Tokenizer.from_file(PATH), [*ODD, *texts()[:300], *ODD]
    for at_once in (1, 500, 1 << 20):  # texts of a column are cut in portions
        monkeypatch.setattr(tokens, "_AT_ONCE", at_once)
        got = list(tokens.Encoder(PATH).many(pa.array(["before", *column])[1:]))
        assert len(got) == len(column)
        for t, x in zip(column, got, strict=True):
            assert x.tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_what_stands_between_spaces_is_cut_once(monkeypatch):
    class Counted:
        calls = 0

        def findall(self, text, cut=tokens._CUT):
            Counted.calls += 1
            return cut.findall(text)

    monkeypatch.setattr(tokens, "_CUT", Counted())
    column = ["one, two. three " * k + "end" for k in range(1, 200)]
    assert sum(len(x) for x in tokens.Encoder(PATH).many(pa.array(column))) > 60_000
    assert Counted.calls <= 5  # four pieces, and the one without a space before it


def test_frequent_pairs_have_symbols_and_a_frame_is_smaller_than_the_codes_of_its_ids():
    words = tokens.encoder(PATH)
    docs = [np.append(words(t), np.uint16(2)) for t in texts()]
    ids = np.concatenate(docs)
    assert len(ids) > tokens._JOINED
    frame = tokens.write_frame(docs)
    assert all(np.array_equal(a, b) for a, b in zip(docs, tokens.read_frame(frame), strict=True))
    assert len(frame) < sum(map(len, tokens.encode_blocks([ids[s : s + tokens.BLOCK] for s in range(0, len(ids), tokens.BLOCK)])))
    for at in (30, len(frame) // 20, len(frame) // 2):
        broken = bytearray(frame)
        broken[at] ^= 16
        with pytest.raises(ValueError):
            tokens.read_frame(bytes(broken))


@pytest.mark.parametrize("kind", ["same", "few", "all", "random"])
def test_frames_with_symbols_of_odd_ids(kind):
    n, rng = tokens._JOINED + 4097, np.random.default_rng(3)
    ids = {"same": np.full(n, 7), "few": rng.integers(65530, 65535, n), "all": np.arange(n) % 65535, "random": rng.integers(0, 65535, n)}[kind].astype(np.uint16)
    docs = np.split(ids, [0, 5, 5, 60_000])
    assert all(np.array_equal(a, b) for a, b in zip(docs, tokens.read_frame(tokens.write_frame(docs)), strict=True))


def test_new_words_go_to_the_library_together_and_met_ones_not_again(monkeypatch):
    fast, plain = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    asked = []
    monkeypatch.setattr(fast, "asked", lambda words, ask=fast.asked: asked.append(words.count(b"\0") + 1) or ask(words))
    column = [f"aa {' '.join(f'quor{chr(97 + k % 26)}{chr(97 + k // 26)}x, vel' for k in range(300))} end." for _ in range(3)]
    for _ in range(2):
        for t, x in zip(column, fast.many(pa.array(column)), strict=True):
            assert x.tolist() == plain.encode(t, add_special_tokens=False).ids
    assert len(asked) <= 3 and sum(asked) <= 310
