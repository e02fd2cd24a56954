import random

import numpy as np
import pytest

from ctxvote.llm import tokens
from ctxvote.llm.tokens import Encoder, UnitTable, tokenizer_json

PARTS = ["word", "Wörter", "don't", "it's", "'s", "'ll", "'Re", "'", "x,", "y.", "12", "3.5", "a1b2", "\n", "\n\n", " ", "  ", "\t", "\xa0", "\u2003", "\x1c", "\x85", "!!", "***", "É", "中文", "ʰ", "٣", "²", "_", "a_b", "×", "<|endoftext|>", "😀", "\r\n", "ǅ", "-", "(", "\u0301", "\u180e", "\u0870", "\x00"]
MARKS = [c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()] + ["«", "»", "—", "“", "”", "…", "¿", "¡", "\n"]


def check(enc, texts):
    expected = [np.asarray(x.ids, "<u4").tobytes() for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert enc.encode(raw) == expected
    assert enc.encode(raw[::-1]) == expected[::-1]
    assert not any(np.frombuffer(x, "<u4").max(initial=0) == 50256 for x in expected)


@pytest.mark.parametrize("cache", [50, 100_000])
def test_units_give_the_ids_of_whole_texts(cache):
    enc = Encoder(tokenizer_json(), cache)
    assert enc.by_unit
    rng = random.Random(4)
    texts = ["", " ", "a", " a", "a ", "a \nb", "a\n b", "a\n\n b", "\n", "foo.\nBar x", "a  b", "<|endoftext|> x", "'s't'", "x''s", "'", "a'", "a's", "'sx 'rex 'llx"]
    texts += ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", ""]) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    check(enc, texts)


def test_every_leading_and_trailing_mark():
    texts = [f"a {m}word{n} b{m} {n}c" for m in MARKS for n in MARKS] + [f"{m}{n}word {m}" for m in MARKS for n in MARKS]
    check(Encoder(tokenizer_json()), texts)


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    monkeypatch.setattr(tokens, "RUN_BYTES", 60)
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", ""]) for _ in range(rng.randint(1, 200))) for _ in range(100)]
    check(Encoder(tokenizer_json(), 300), texts + ["x" * 1000, " " * 500, "é " * 300])


def test_other_pre_tokenizers_get_whole_texts():
    import public_tokenizers

    enc = Encoder(tokenizer_json(public_tokenizers.path("word_bpe_49k.json")))
    assert not enc.by_unit
    assert enc.encode([b"Some  words, here"]) == [enc.whole("Some  words, here")]


def test_unit_table_against_a_dictionary():
    rng, table, known = random.Random(6), UnitTable(), {}
    for step in range(40):
        units = [bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randint(1, rng.choice([3, 8, 9, 16, 17, 23])))) for _ in range(300)]
        sizes = np.asarray([len(u) for u in units])
        keys = UnitTable.keys_of(np.frombuffer(b"".join(units), np.uint8), np.cumsum(sizes) - sizes, sizes)
        assert table.find(keys).tolist() == [known.get(u, -1) for u in units]
        new = [i for i, u in enumerate(units) if u not in known and u not in units[:i]]
        table.add([k[new] for k in keys])
        known |= {units[i]: len(known) + j for j, i in enumerate(new)}
        assert table.find(keys).tolist() == [known[u] for u in units]
        if step % 10 == 9:
            stay = sorted(rng.sample(range(len(known)), len(known) // 2))
            table.keep(np.asarray(stay))
            names = list(known)
            known = {names[n]: i for i, n in enumerate(stay)}


def test_units_of_large_vocabularies_are_encoded_once():
    enc = Encoder(tokenizer_json())
    letters = str.maketrans("0123456789", "ghijklmnop")
    text = "".join(f" {i:x}q" for i in range(450_000)).translate(letters).encode()
    first = enc.encode([text])
    asked = []
    plain = enc._encode_missing
    enc._encode_missing = lambda units, flags: asked.append(len(units)) or plain(units, flags)
    assert enc.encode([text]) == first
    assert sum(asked) < 10, asked
