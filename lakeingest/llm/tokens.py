"""Token ids of texts by the public tokenizers: memoised by piece, with the same ids as whole-text encoding.

Both vocabularies split a text in front of white space, and between letters or digits and other marks
(but for an apostrophe and what follows it), and what stands on one side of such a place does not
change the ids of the other side. A text is therefore cut there, and a worker encodes each frequent
piece once. Arrow cuts a batch of texts at blanks and single line ends and finds its distinct words; the ASCII marks at
the end of a word are looked up by themselves, and the ids of all words are gathered by position. A new word of letters
only, which is one piece, goes straight to the library's model, without the search for pieces. Texts with white space beyond blank, tab and line ends, on which regular-expression
engines may differ, and texts that normalisation would change, are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words, and pieces of odd words, that a worker remembers (about 200 bytes each); others are encoded each time.
MEMO = 800_000
#: The id that ends every document.
END = 1

_MARKS = r"(?:[^\w\s]|_)+(?:(?<=')[^\W_]+)?"
_PIECES = {
    "space_led": re.compile(rf"\s*(?:[^\W_]+|{_MARKS})|\s+"),
    "word_end": re.compile(rf"[^\W_]+|{_MARKS}"),
}
_CONTROL = re.compile("[\x0b\x0c\x1c-\x1f]")
_ODD = re.compile("[\x85\xa0 ᠎ -​    　﻿]")

#: White space around a blank: such texts, and those with a blank at either end, are cut by pieces, not by words.
_RUNS = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")
#: ``has_odd_space``, and not ``blanks_apart``, for Arrow arrays.
_ODD_SPACE = _CONTROL.pattern[:-1] + _ODD.pattern[1:]
_RUN_OF_WHITE = r"\A | \z|[ \n\t\r] | [\n\t\r]"
_WHITE = re.compile("[\n\t\r]")
#: Stands in front of a word for a line end in place of its blank; a text with this character in it is encoded whole.
_LINE = "\x0b"
#: ASCII marks, and the first character behind those whose class (letter, number or neither) no Unicode version changes.
_ASCII_MARKS, _LATER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()), "\u0250"
#: How byte-level vocabularies write bytes that are no visible characters.
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}


def has_odd_space(text: str) -> bool:
    """Whether a text has white space on which regular-expression engines may differ."""
    return bool(_CONTROL.search(text) or not text.isascii() and _ODD.search(text))


def blanks_apart(text: str) -> bool:
    """Whether every blank stands between two characters that are no white space."""
    return text[0] != " " != text[-1] and not any(run in text for run in _RUNS)


def simple_words(text: str) -> list[str] | None:
    """What stands between the blanks of a text, if no vocabulary has a token across them, else None."""
    return text.split(" ") if blanks_apart(text) and not has_odd_space(text) else None


def _stems(words: list[str]) -> list[str]:
    """Words without the ASCII marks at their end, where these are a piece of their own."""
    cut = [w.rstrip(_ASCII_MARKS) for w in words]
    return [s if s[-1:].isalnum() and s[-1] < _LATER else w for w, s in zip(words, cut)]


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_cache() -> dict:
    """A dictionary of the worker process. Task functions travel by value, so their own module state does not last."""
    return vars(sys.modules.setdefault("lakeingest_worker_cache", ModuleType("lakeingest_worker_cache")))


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. ``kind`` names how the vocabulary treats white space.

    The strings of special tokens in a text are the special tokens, as in the library's own calls, or ordinary text
    if ``plain_specials`` is set.
    """

    def __init__(self, path: str, kind: str, plain_specials: bool = False, memo: int = MEMO):
        self.memo = memo
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        added = () if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else None
        self.led = kind == "space_led"
        self.find = _PIECES[kind].findall
        # What joins pieces for one call: never part of a joined piece, and always one id of its own.
        self.joint = "\n" if self.led else "\n~\n"
        self.joint_id = self.tokenizer.encode(self.joint, add_special_tokens=False).ids[0]
        if self.led:  # the same model for words that are a single piece, already in the vocabulary's writing
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.leads[[i for t, i in self.tokenizer.get_vocab(False).items() if t[0] == "Ġ"]] = True
        self.line = np.array([self.joint_id], "<u4").tobytes()
        self.words: dict[str, bytes] = {"": b"", _LINE: self.line}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str, kind: str, plain_specials: bool = False, memo: int = MEMO) -> "Encoder":
        """One encoder per worker process, so that its memo serves all its tasks."""
        kept = worker_cache()
        if (path, kind, plain_specials, memo) not in kept:
            kept[path, kind, plain_specials, memo] = cls(path, kind, plain_specials, memo)
        return kept[path, kind, plain_specials, memo]

    def direct(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, many in one call."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 2000):
            text = self.joint.join(pieces[i : i + 2000]) + self.joint
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self.joint_id)).tolist()
            data, start = ids.tobytes(), 0
            for end in ends:
                out.append(data[start:end])
                start = end + 4
        return out

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, cut into pieces; texts need not be whole documents."""
        found = [self.find(t) for t in texts]
        memo = self.pieces
        new = [p for p in set(chain.from_iterable(found)) if p not in memo]
        # Pieces that could run into the joint go by themselves: white space beyond one leading blank, or the joint's mark.
        alone = [p for p in new if p[-1].isspace() or p[:2].isspace() or p[0] in "\n\t\r"] if self.led else [p for p in new if "~" in p]
        memo.update(zip(alone, self.direct(alone)))
        plain = [p for p in new if p not in memo]
        memo.update(zip(plain, self._joined(plain)))
        out = [b"".join(map(memo.__getitem__, x)) for x in found]
        if len(memo) > self.memo:
            for p in new:
                del memo[p]
        return out

    def _lettered(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, as they are behind a blank, many in one call."""
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            text = "Ġ" + " Ġ".join(words[i : i + 2000])
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts, data = (4 * np.flatnonzero(self.leads[ids])).tolist(), ids.tobytes()
            out += [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]
        return out

    def _remember(self, new: list[str]) -> None:
        """Puts words into the memo, as they are behind a blank (``led``), behind a line end (``_LINE`` in front) or anywhere."""
        memo = self.words
        if not self.led:
            odd = [w for w in new if "~" in w]
            memo.update(zip(odd, self._pieces(odd)))
        else:
            letters = [w for w in new if w.isalpha()]
            ascii_only = [w for w in letters if w.isascii()]
            memo.update(zip(ascii_only, self._lettered(ascii_only)))
            others = [w for w in letters if not w.isascii() and max(w) < _LATER]
            memo.update(zip(others, self._lettered([w.encode().decode("latin-1").translate(_BYTE_LEVEL) for w in others])))
            lined = [w for w in new if w[0] == _LINE]
            memo.update((w, self.line + ids) for w, ids in zip(lined, self._joined([w[1:] for w in lined])))
            odd = [w for w in new if _WHITE.search(w)]
            memo.update(zip(odd, self._pieces([" " + w for w in odd])))
        plain = [w for w in new if w not in memo]
        memo.update(zip(plain, self._joined([" " + w for w in plain] if self.led else plain)))

    def behind_blanks(self, words: list[str]) -> list[bytes]:
        """The ids of words that have a blank in front, such as ``simple_words`` cuts."""
        memo = self.words
        out = list(map(memo.get, words))
        lacking = [i for i, ids in enumerate(out) if ids is None]
        if lacking:
            found = [words[i] for i in lacking]
            stems = _stems(found)
            ends = [w[len(s) :] for w, s in zip(found, stems)]
            new = [s for s in set(stems) if s not in memo]
            self._remember(new)
            marks = list(set(ends))
            of_marks = dict(zip(marks, self._pieces(marks)))
            for i, s, end in zip(lacking, stems, ends):
                out[i] = memo[s] + of_marks[end]
            if len(memo) > self.memo:
                for w in new:
                    del memo[w]
        return out

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that are cut at their blanks (``led``) or white space: those of the distinct words, put in the words' places."""
        cut = pc.split_pattern(texts, " ") if self.led else pc.ascii_split_whitespace(texts)
        starts, coded = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        ids, codes = self.behind_blanks(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        if self.led:  # the first word has no blank in front of it
            codes = codes.copy()
            codes[starts[:-1]] = np.arange(len(ids), len(ids) + len(texts))
            ids += self._pieces(cut.values.take(pa.array(starts[:-1])).to_pylist())
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        first = np.cumsum(lengths, dtype=np.int32) - lengths
        sizes = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(first[codes] - ends[:-1].astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")[at]
        places = ends[starts].tolist()
        return [flat[a:b].tobytes() for a, b in zip(places, places[1:])]

    def __call__(self, texts: list[str | None] | pa.Array, end: int = END) -> list[bytes]:
        """The ids of every text followed by ``end``."""
        tail = np.array([end], "<u4").tobytes()
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = array.to_pylist()
        out: list[bytes] = [tail] * len(texts)
        whole = pc.match_substring_regex(array, _ODD_SPACE).to_pylist()
        runs = pc.match_substring_regex(array, _RUN_OF_WHITE).to_pylist() if self.led else [False] * len(texts)
        rest: list[int] = []
        simple: list[int] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if whole[i] or self.special and self.special(t) or not t.isascii() and not unicodedata.is_normalized("NFC", t):
                out[i] = self.direct([t])[0] + tail
            else:
                (rest if runs[i] else simple).append(i)
        for i, ids in zip(rest, self._pieces([texts[i] for i in rest])):
            out[i] = ids + tail
        if simple:
            cut = array.take(pa.array(simple, pa.int32()))
            if self.led:  # a single line end between words leads the word behind it, as a blank does
                cut = pc.if_else(pc.match_substring_regex(cut, "\n\n|[\t\r]"), cut, pc.replace_substring(cut, "\n", " " + _LINE))
            for i, ids in zip(simple, self._by_words(cut)):
                out[i] = ids + tail
        return out
