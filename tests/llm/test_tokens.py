import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lakeingest.llm.tokens import Encoder, public_tokenizer

KINDS = (("byte_bpe_50k.json", "space_led"), ("word_bpe_49k.json", "word_end"))


@pytest.mark.parametrize("plain", (False, True))
@pytest.mark.parametrize("name,kind", KINDS)
def test_pieces_give_the_ids_of_whole_texts(name, kind, plain):
    rng = random.Random(2)
    alphabet = " \n\t\rabcAB1'2s!.~é́ß#<|>_ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["it's  don't\r\n\r\nok", "  x", "x  ", "a\n\n b", "a~b ~ c", "<|endoftext|> a", "a <|EndOfText|>b<|startoftext|>", "日本語 12 345", "x\x1cy", None, ""]
    encode = Encoder(public_tokenizer(name), kind, plain)
    library = Tokenizer.from_file(public_tokenizer(name))
    if plain:
        library.encode_special_tokens = True
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for _ in range(2):  # the second time from memory
        assert [x[:-4] for x in encode(texts)] == want
    assert all(x[-4:] == b"\1\0\0\0" for x in encode(texts))


@pytest.mark.parametrize("name,kind", KINDS)
def test_marks_lines_and_letters_of_any_kind(name, kind):
    rng = random.Random(7)
    tokens = ["word", "Wort", "größe", "été", "ɏa", "aɐ", "ƛx", "ª", "µm", "x²", "3½", "7", "a×b", "÷", "don't", "x'", "'s", "слово", "日本", "a\x01", "é…", "_", "~a"]
    ends = ["", "", "", ".", ",", "***", ".&&&", "'", "';", "…", "….", "\x01.", "~", "_", "²!"]
    between = [" ", " ", " ", "\n", "\n", "\n\n", "\n\n\n", "\r\n", "\t", "  "]
    texts = []
    for _ in range(3000):
        some = between if rng.random() < 0.4 else between[:5]
        texts.append(rng.choice(["", "", "\n", " "]) + "".join(rng.choice(tokens) + rng.choice(ends) + rng.choice(some) for _ in range(rng.randint(1, 9))))
    library = Tokenizer.from_file(public_tokenizer(name))
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for memo in (800_000, 5):  # 5: words are forgotten after each call
        encode = Encoder(public_tokenizer(name), kind, memo=memo)
        for k in range(0, len(texts), 500):
            assert [x[:-4] for x in encode(pa.array(texts[k : k + 500], pa.string()))] == want[k : k + 500]
        assert [x[:-4] for x in encode(texts[:500])] == want[:500]


def test_words_behind_blanks_may_begin_with_a_line_end():
    encode = Encoder(public_tokenizer("byte_bpe_50k.json"), "space_led", True)
    encode(["so\nfoo bar", "\nfoo"])
    words = ["\nfoo", "foo", "foo.", "\nfoo.", "x\ny"]
    assert encode.behind_blanks(words) == encode.direct([" " + w for w in words])


@pytest.mark.parametrize("name,kind", KINDS)
def test_marks_and_line_ends_make_no_new_words(name, kind):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioudnrst") for _ in range(8)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "!!"]) for _ in range(400)) for _ in range(50)]
    encode = Encoder(public_tokenizer(name), kind)
    encode(["\n".join(texts[k : k + 5]) for k in range(0, 50, 5)])
    assert len(encode.words) <= 2 * len(words) + 2 and len(encode.pieces) <= 100  # each behind a blank and behind a line end at most
