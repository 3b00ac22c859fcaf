"""Token ids by the tokenizers library, at the cost of the distinct chunks of a block.

A text is cut at each space; a chunk keeps the space before it. Chunks are encoded by the library
once for each worker and put together by NumPy. Where the cut could change the library's own split
(white space on both sides of it, for a tokenizer that keeps white space), the whole text is encoded
by the library at once. The results equal those of encode() on whole texts.

Where a tokenizer cuts lower-cased texts to WORDS, a chunk of plain characters is cut to its words here, so
the library gets each distinct word once, not once for each case and punctuation that it is found with.
So are the plain chunks of a byte-level tokenizer, by its own regular expression. Texts of SPLIT_BYTES alone are cut to
these words by NumPy, a block at a time, without chunks.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: A tokenizer's words, and the same for lower-cased texts of PLAIN characters: those that NFC leaves alone, without apostrophes (of 's and the like) and < (of special tokens).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[\t\n\r !-&(-;=-~À-ÖØ-öø-ÿ]*")
PLAIN_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
#: The byte-level split of the library for texts of PLAIN_BYTES: those whose letters, numbers and white space are these, without < (of special tokens).
PLAIN_BYTES = re.compile(r"[\t\n\r !-;=-~À-ÖØ-öø-ÿ]*")
BYTE_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")

#: Classes of the bytes of texts that NumPy cuts as BYTE_WORDS does: letters, numbers, other characters, spaces, other white space. Not of them: apostrophes, < and all beyond PLAIN_BYTES.
SPLIT_BYTES = np.full(256, 5, np.uint8)
for _kind, _own in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789", b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~", b" ", b"\t\n\r")):
    SPLIT_BYTES[list(_own)] = _kind
ODD = r"[^\t\n\r !-&(-;=-~À-ÖØ-öø-ÿ]"
SPLIT_BYTES[0x80:0xC0] = SPLIT_BYTES[0xC3] = 0  # where ODD finds nothing these are À to ÿ

BLANK = np.array([c for c in range(0x110000) if chr(c).isspace() or c == 0x180E], np.uint32)


def blanks(chars: list[str]) -> np.ndarray:
    """Which of the characters are white space; none at all counts as such."""
    return np.isin(np.frombuffer("".join([c or " " for c in chars]).encode("utf-32-le"), np.uint32), BLANK)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that where names, one after another, and their sizes."""
    n = sizes[where]
    at = np.repeat(starts[where] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat[at], n


def refuse_others(path: str, keeps_space: bool) -> None:
    """Raise ValueError unless cutting at spaces is right for a tokenizer file: byte-level without normalizer, or words of folded white space."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    normalizer, pre = spec.get("normalizer") or {"type": None}, spec.get("pre_tokenizer") or {"type": None}
    if keeps_space:
        fits = normalizer["type"] is None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
    else:
        steps, cuts = normalizer.get("normalizers", []), pre.get("pretokenizers", [])
        fits = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        fits = fits and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"]
    plain = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    if not (fits and plain and spec["model"]["type"] == "BPE" and spec["added_tokens"]):
        raise ValueError(f"{path} isn't a tokenizer whose texts can be cut at spaces")


class ChunkEncoder:
    """encode() gives the ids of texts. keeps_space: whether white space has tokens of its own.

    limit: so many distinct chunks are held at most; beyond it the memory of chunks starts anew.
    """

    def __init__(self, path: str, keeps_space: bool, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        refuse_others(path, keeps_space)
        self.tokenizer, self.keeps_space, self.limit = Tokenizer.from_file(path), keeps_space, limit
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        marks = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = next(iter(marks.items()))
        self.first = os.path.commonprefix(self.special)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        end = spec["model"].get("end_of_word_suffix")
        self.by_words = not keeps_space and bool(end) and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": WORDS}
        self.by_bytes = keeps_space and all(x.startswith("<") for x in self.special)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # the tokens that end a word
        self.ends[[i for token, i in vocab.items() if end and token.endswith(end)]] = True
        self.starts_word = np.zeros(len(self.ends), bool)  # the byte-level tokens that begin with a space
        self.starts_word[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict = defaultdict()
        self.index.default_factory = self.index.__len__
        self.known = 0
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.opens = np.zeros(0, bool)
        self.closes = np.zeros(0, bool)
        self.seen = np.zeros(0, np.int64)
        self.clear_units()

    def clear_units(self) -> None:
        """Forget the words, and the other chunks (in tuples), that chunks are made of."""
        self.units: defaultdict = defaultdict()
        self.units.default_factory = self.units.__len__
        self.unit_flat = np.zeros(0, np.uint32)
        self.unit_starts = np.zeros(0, np.int64)
        self.unit_sizes = np.zeros(0, np.int64)

    def renew(self) -> None:
        """Keep the chunks that were found twice or more, the most frequent half of the limit at most; forget the others."""
        again = np.flatnonzero(self.seen > 1)
        if len(again) > self.limit // 2:
            order = np.argsort(-self.seen[again], kind="stable")
            again = np.sort(again[order[: self.limit // 2]])
        keys = list(self.index)
        kept = [keys[i] for i in again.tolist()]
        self.index.clear()
        self.index.update(zip(kept, range(len(kept)), strict=True))
        self.known, sizes = len(kept), self.sizes[again]
        self.flat, _ = gathered(self.flat, self.starts, self.sizes, again)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.opens, self.closes = self.opens[again], self.closes[again]
        self.seen = np.ones(len(kept), np.int64)

    def encode_each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings, one after another, and their numbers of ids; 1000 at a time, kept apart by a special token's text."""
        mark, mark_id = self.mark
        ids, sizes = [], []
        for start in range(0, len(strings), 20_000):  # the library's own results are large, so few at a time
            batches = [strings[i : i + 1000] for i in range(start, min(start + 20_000, len(strings)), 1000)]
            joined = [mark.join(x) for x in batches]
            for own_strings, text, x in zip(batches, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                if text.count(self.first) != len(own_strings) - 1:  # one holds a special token's text itself, perhaps
                    got = [y.ids for y in self.tokenizer.encode_batch_fast(own_strings, add_special_tokens=False)]
                    sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
                    ids.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32))
                    continue
                own = np.array(x.ids, np.uint32)
                cut = own == mark_id
                sizes.append(np.diff(np.append(np.flatnonzero(cut), len(own)), prepend=-1) - 1)
                ids.append(own[~cut])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for PLAIN_WORDS, or BYTE_WORDS that begin with a space: 200 at a time, with spaces between them; the tokens tell where words end."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for start in range(0, len(words), 20_000):
            batches = [words[i : i + 200] for i in range(start, min(start + 20_000, len(words)), 200)]
            for own_words, x in zip(batches, self.tokenizer.encode_batch_fast([("" if self.by_bytes else " ").join(b) for b in batches], add_special_tokens=False), strict=True):
                own = np.array(x.ids, np.uint32)
                n = np.diff(np.flatnonzero(self.starts_word[own]), append=len(own)) if self.by_bytes else np.diff(np.flatnonzero(self.ends[own]), prepend=-1)
                if len(n) != len(own_words):  # a vocabulary without some word's end
                    own, n = self.encode_each(own_words)
                ids.append(own)
                sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn_units(self, known: int) -> None:
        """Encode the units from number known on."""
        new = list(itertools.islice(self.units, known, None))
        if self.by_bytes:
            is_word = np.fromiter((type(x) is str and x[0] == " " and not x.isspace() for x in new), bool, len(new))
        else:
            is_word = np.fromiter((type(x) is str for x in new), bool, len(new))
        words = list(itertools.compress(new, is_word))
        others = [x if type(x) is str else x[0] for x in itertools.compress(new, ~is_word)]
        ids, n = self.encode_words(words)
        if others:
            other_ids, other_n = self.encode_each(others)
            ids, n = np.concatenate([ids, other_ids]), np.concatenate([n, other_n])
        place = np.append(np.flatnonzero(is_word), np.flatnonzero(~is_word))  # of the words, then of the others
        starts, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        starts[place], sizes[place] = len(self.unit_flat) + np.cumsum(n) - n, n
        for name, x in (("unit_flat", ids), ("unit_starts", starts), ("unit_sizes", sizes)):
            setattr(self, name, np.concatenate([getattr(self, name), x]))

    def encode_by_words(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same as encode_each, by the words of plain strings; others are encoded whole."""
        if len(self.units) > self.limit:
            self.clear_units()
        known = len(self.units)
        if self.by_bytes:
            made = [BYTE_WORDS.findall(x) or [(x,)] if PLAIN_BYTES.fullmatch(x) else [(x,)] for x in strings]
        else:
            made = [PLAIN_WORDS.findall(x.lower()) if PLAIN.fullmatch(x) else [(x,)] for x in strings]
        where = np.fromiter(map(self.units.__getitem__, itertools.chain.from_iterable(made)), np.int64)
        self.learn_units(known)
        ids, n = gathered(self.unit_flat, self.unit_starts, self.unit_sizes, where)
        before, ends = np.append(0, np.cumsum(n)), np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
        return ids, np.diff(before[ends], prepend=0)

    def encode_split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same as encode for a byte-level tokenizer and texts (large strings) in which there is no ODD character."""
        if len(self.units) > self.limit:
            self.clear_units()
        cut = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data, cut = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cut[0] : cut[-1]], cut - cut[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        kind = SPLIT_BYTES[data]
        white, first, begins = kind >= 3, np.zeros(len(data) + 1, bool), np.zeros(len(data), bool)
        first[cut] = True  # of a text
        begins[1:] = (np.minimum(kind[1:], 3) != np.minimum(kind[:-1], 3)) & ((kind[:-1] != 3) | white[1:])  # a space goes with what follows
        begins[:-1] |= white[:-1] & ~white[1:] & ~first[1:-1]  # as the last white character before something does, or it is alone
        begins |= first[:-1]
        at = np.append(np.flatnonzero(begins), len(data))
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        known = len(self.units)
        where = np.fromiter(map(self.units.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[coded.indices.to_numpy()]
        self.learn_units(known)
        ids, n = gathered(self.unit_flat, self.unit_starts, self.unit_sizes, where)
        return ids, np.diff(np.append(0, np.cumsum(n))[np.searchsorted(at, cut)])

    def learn(self) -> None:
        """Encode the chunks that are new in index."""
        new = list(itertools.islice(self.index, self.known, None))
        if not new:
            return
        self.known = len(self.index)
        if self.by_bytes:
            ids, sizes = self.encode_by_words([x[0] if type(x) is tuple else f" {x}" for x in new])
        elif self.by_words:
            ids, sizes = self.encode_by_words([x[0] if type(x) is tuple else x for x in new])
        else:
            ids, sizes = self.encode_each([x[0] if type(x) is tuple else f" {x}" for x in new])
        starts = np.cumsum(sizes) - sizes
        added = [("flat", ids), ("starts", len(self.flat) + starts), ("sizes", sizes), ("seen", np.zeros(len(new), np.int64))]
        if self.keeps_space:
            bare = [x[0] if type(x) is tuple else x for x in new]
            added += [("opens", blanks([x[:1] for x in bare])), ("closes", blanks([x[-1:] for x in bare]))]
        else:
            added += [("opens", np.zeros(len(new), bool)), ("closes", np.zeros(len(new), bool))]
        for name, x in added:
            setattr(self, name, np.concatenate([getattr(self, name), x]))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (without nulls), one after another, and each text's number of ids.

        Arrow cuts the texts and finds the distinct chunks of the block, so Python sees each of these once.
        """
        if len(self.index) > (self.limit // 2 if self.by_bytes else self.limit):  # a byte-level tokenizer has as many words, and they are what costs
            self.renew()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string())
        if self.by_bytes:
            odd = pc.match_substring_regex(texts, ODD)
            n_odd = pc.sum(odd).as_py()
            if not n_odd:
                return self.encode_split(texts)
            if n_odd < len(texts):
                is_odd = odd.to_numpy(zero_copy_only=False)
                parts = [self.encode(texts.filter(pc.invert(odd))), self.encode(texts.filter(odd))]
                sizes, starts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for own, before, (_, n) in zip((~is_odd, is_odd), (0, len(parts[0][0])), parts, strict=True):
                    sizes[own], starts[own] = n, before + np.cumsum(n) - n
                return gathered(np.concatenate([x for x, _ in parts]), starts, sizes, np.arange(len(texts)))
        cut = pc.split_pattern(texts, " ")
        chunks, ends = cut.flatten(), np.cumsum(pc.list_value_length(cut).to_numpy())
        firsts = np.append(0, ends[:-1])
        coded = chunks.dictionary_encode()
        each = self.index.__getitem__
        where = np.fromiter(map(each, coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))[coded.indices.to_numpy()]
        where[firsts] = np.fromiter((each((x,)) for x in chunks.take(pa.array(firsts)).to_pylist()), np.int32, len(firsts))
        self.learn()
        self.seen += np.bincount(where, minlength=self.known)
        ids, sizes = gathered(self.flat, self.starts, self.sizes, where)
        lengths = np.add.reduceat(sizes, firsts)
        if self.keeps_space:
            bad = self.closes[where[:-1]] & self.opens[where[1:]]
            bad[ends[:-1] - 1] = False  # between two texts
            if bad.any():
                whole = np.unique(np.searchsorted(ends, np.flatnonzero(bad), side="right"))
                pieces = np.split(ids, np.cumsum(lengths)[:-1])
                for i in whole:
                    pieces[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
                    lengths[i] = len(pieces[i])
                ids = np.concatenate(pieces)
        return ids, lengths


_held: dict = {}


@contextmanager
def encoder(path: str, keeps_space: bool) -> Iterator[ChunkEncoder]:
    """This worker's encoder for a tokenizer file. Its chunks go with the task, as the worker's next one can be of another operator, which needs the memory."""
    if (path, keeps_space) not in _held:
        _held[path, keeps_space] = ChunkEncoder(path, keeps_space)
    try:
        yield _held[path, keeps_space]
    finally:
        _held[path, keeps_space].clear()
