"""BPE encoding and decoding of whole texts, word by word, by dynamic programming over prefixes.

Every prefix of a word has exactly one BPE encoding, and dropping its last token gives the encoding of a shorter
prefix. So it is enough to store, for every prefix, its one last token: among the tokens that end there (found by one
pass of an Aho-Corasick automaton over the word) it is the one that is compatible with the last token of the prefix
before it. Two tokens are compatible if running the merges on their joint text never merges across their border; that
is decided by walking up the pieces on both sides of the border in the order of merge ranks, and remembered. Following
the back-pointers from the end of the word gives the exact ids.

The texts' preparation (normal form, white space, lower case, splitting into words) is that of the vocabulary file,
which a parameter names. Texts that hold only common characters are split by a fast pattern that finds the same words;
all others by the library's own normalizer and pre-tokenizer. Texts of the first kind are encoded many at a time: each
different word of them goes through the recurrence once, many words side by side. In others words met before are looked
up.

Defined cases: a null or empty text has no ids and decodes to the empty string; special tokens' strings in a text are
those tokens, as in the tokenizers library; rows are encoded each by itself, repeated or not; an empty table gives an
empty table; extra columns are not read; a word that no sequence of the vocabulary's tokens covers (none, where it has
all bytes) raises an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words that a worker remembers; it starts anew beyond that.
REMEMBERED = 100_000
#: Pairs of tokens whose compatibility a worker remembers.
REMEMBERED_PAIRS = 500_000
NEVER = 1 << 60
#: So many words go through the recurrence together; words of more bytes go one by one.
TOGETHER, LONG = 20_000, 64
#: Bytes of the batches whose texts are encoded together.
GROUP_BYTES = 16 << 20
#: Size of the table of pairs' answers, what spreads pairs over it, and what stands in it at first.
ANSWER_BITS, SPREAD, NO_ANSWER = 20, np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (the published GPT-2 rule)."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


class Splitter:
    """Text -> words, prepared as the vocabulary file says."""

    def __init__(self, path: str, spec: dict):
        from tokenizers import Tokenizer

        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        self.usual = kinds == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"]["pretokenizers"][0]["type"] == "Split"
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.raw = {c: b for b, c in enumerate(byte_symbols())}
        #: Within these characters \w, \d and \s split as \p{L}, \p{N} and white space do, and lower() is char by char.
        self.common = re.compile("[\t-\r -~¡-©«-±´¶-¸»¿-įı-ſ‐-‧€]*")
        self.fast = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")

    def words(self, text: str) -> list[str]:
        if self.usual and self.common.fullmatch(text):
            return self.fast.findall(text.lower())
        raw = self.raw
        return [bytes([raw[c] for c in w]).decode() for w, _ in self.pre_tokenize(self.normalize(text))]


class WordEncoder:
    """Word -> ids by the recurrence over prefixes."""

    def __init__(self, spec: dict):
        import ahocorasick

        model, symbols = spec["model"], byte_symbols()
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        rank = {}
        parts = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ", 1)
            made = self.vocab[left + right]
            rank[self.vocab[left], self.vocab[right]] = i
            parts.setdefault(made, (self.vocab[left], self.vocab[right], i))
        self.rank, self.parts = rank, parts
        #: One character for each symbol (a byte, or a byte at the end of a word), so that a word is a plain string.
        self.inner = {b: chr(0x4E00 + b) for b in range(256)}
        self.final = {b: chr(0x4F00 + b) for b in range(256)}
        by_symbol = {symbols[b]: b for b in range(256)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.lengths = np.zeros(max(self.vocab.values()) + 1, np.int64)
        reachable = set(parts) | {self.vocab[symbols[b] + e] for b in range(256) for e in ("", self.suffix) if symbols[b] + e in self.vocab}
        for token, i in self.vocab.items():
            if i not in reachable:
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix)
            plain = token[: -len(self.suffix)] if ends else token
            if not plain or any(c not in by_symbol for c in plain):
                continue
            codes = [self.inner[by_symbol[c]] for c in plain]
            if ends:
                codes[-1] = self.final[by_symbol[plain[-1]]]
            self.automaton.add_word("".join(codes), i)
            self.lengths[i] = len(codes)
        self.automaton.make_automaton()
        self.inner_table = {b: ord(c) for b, c in self.inner.items()}
        self.sizes = self.lengths.tolist()
        self.rights, self.lefts, self.known = {}, {}, {}
        self.answers = np.full(1 << ANSWER_BITS, NO_ANSWER, np.uint64)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece, rank of the merge that consumes it) of the pieces at one border of a token, smallest first."""
        path, now, consumed = [], token, NEVER
        while True:
            path.append((now, consumed))
            if now not in self.parts:
                return path[::-1]
            consumed = self.parts[now][2]
            now = self.parts[now][side]

    def _judge(self, left: int, right: int) -> bool:
        ours = self.rights.get(left)
        if ours is None:
            ours = self.rights[left] = self._spine(left, 1)
        theirs = self.lefts.get(right)
        if theirs is None:
            theirs = self.lefts[right] = self._spine(right, 0)
        i = j = 0
        while True:
            (a, a_gone), (b, b_gone) = ours[i], theirs[j]
            across = self.rank.get((a, b), NEVER)
            if across < a_gone and across <= b_gone and across < NEVER:
                return False
            if a_gone == b_gone == NEVER:
                return True
            if a_gone <= b_gone:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges on left's text followed by right's end as these two tokens."""
        key = left << 20 | right
        known = self.known.get(key)
        if known is None:
            known = self._judge(left, right)
            if len(self.known) >= REMEMBERED_PAIRS:
                self.known.clear()
            self.known[key] = known
        return known

    def ids(self, word: str) -> list[int]:
        raw = word.encode()
        codes = raw[:-1].decode("latin-1").translate(self.inner_table) + self.final[raw[-1]] if self.suffix else raw.decode("latin-1").translate(self.inner_table)
        last, size, compatible = [-1] * (len(codes) + 1), [0] * (len(codes) + 1), self.compatible
        for at, token in self.automaton.iter(codes):
            end, n = at + 1, self.sizes[token]
            if last[end] >= 0:
                continue
            before = last[end - n]
            if n == end or before >= 0 and compatible(before, token):
                last[end], size[end] = token, n
        out, at = [], len(codes)
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no tokens for {word[:20]!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """compatible() of many pairs. Answers lie in a table of fixed size, where a pair may take another's place."""
        keys = (left << 20 | right).astype(np.uint64)
        slots = keys * SPREAD >> np.uint64(64 - ANSWER_BITS)
        found = self.answers[slots]
        new = np.flatnonzero(found >> np.uint64(1) != keys)
        if len(new):
            asked, at = np.unique(keys[new], return_inverse=True)
            said = np.array([self._judge(k >> 20, k & 0xFFFFF) for k in asked.tolist()], np.uint64)[at]
            found[new] = self.answers[slots[new]] = keys[new] << np.uint64(1) | said
        return found & np.uint64(1) == 1

    def all_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one word's after another's; number of ids of each): the recurrence over the prefixes of one
        length of all words at a time. Long words go one by one."""
        raw = [w.encode() for w in words]
        if any(len(r) > LONG for r in raw):
            ids, counts = self.all_ids([w for w, r in zip(words, raw, strict=True) if len(r) <= LONG])
            short = iter(np.split(ids, np.cumsum(counts)[:-1]))
            each = [np.array(self.ids(w)) if len(r) > LONG else next(short) for w, r in zip(words, raw, strict=True)]
            return np.concatenate(each), np.array(list(map(len, each)))
        if not raw:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        borders = np.cumsum(sizes + 1)  # words follow each other with a place before each, which is its empty prefix
        starts = borders - sizes - 1
        symbols = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8).astype("<u2") + np.uint16(0x4E00)
        if self.suffix:
            symbols[borders - 1] += np.uint16(0x100)
        symbols[starts] = symbols[-1] = ord(" ")
        ends, tokens = np.fromiter(chain.from_iterable(self.automaton.iter(symbols.tobytes().decode("utf-16-le"))), np.int64).reshape(-1, 2).T
        before = ends - self.lengths[tokens]
        prefix = ends - np.repeat(starts, sizes + 1)[ends]
        order, last = np.argsort(prefix, kind="stable"), np.full(borders[-1] + 1, -1)
        for group in np.split(order, np.cumsum(np.bincount(prefix))[:-1]):
            whole = prefix[group] == self.lengths[tokens[group]]
            pairs = group[~whole & (last[before[group]] >= 0)]
            good = np.concatenate([pairs[self._all_compatible(last[before[pairs]], tokens[pairs])], group[whole]])
            last[ends[good]] = tokens[good]
        used, at = np.zeros(len(last), bool), borders - 1
        while len(at):
            if (last[at] < 0).any():
                lost = words[int(np.searchsorted(borders, at[last[at] < 0][0], "right"))]
                raise ValueError(f"the vocabulary has no tokens for {lost[:20]!r}")
            used[at] = True
            at = at - self.lengths[last[at]]
            at = at[symbols[at] != ord(" ")]
        return last[used], np.add.reduceat(used.astype(np.int64), starts)



class Codec:
    """Encodes and decodes texts with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splitter, self.encoder = Splitter(path, spec), WordEncoder(spec)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_start = os.path.commonprefix(list(self.special))
        names = [""] * (max([*self.encoder.vocab.values(), *self.special.values()]) + 1)
        for token, i in {**self.encoder.vocab, **self.special}.items():
            names[i] = token
        self.names, self.tokens = names, pa.array(names, pa.large_string())
        self.seen_ids: dict[str, bytes] = {}
        self.seen_names: dict[str, str] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.seen_ids) >= REMEMBERED:
            self.seen_ids.clear()
            self.seen_names.clear()
        for word in words:
            if word not in self.seen_ids:
                ids = self.encoder.ids(word)
                self.seen_ids[word] = struct.pack(f"<{len(ids)}I", *ids)
                self.seen_names[word] = " ".join([self.names[i] for i in ids])

    def _parts(self, text: str) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit words, tokens joined by spaces) of each stretch between special tokens."""
        for k, part in enumerate(self.find_special.split(text) if self.find_special and self.special_start in text else [text]):
            if k % 2:
                yield self.special[part].to_bytes(4, "little"), part
            elif words := self.splitter.words(part):
                try:
                    ids = b"".join([self.seen_ids[w] for w in words])
                except KeyError:
                    self._learn(words)
                    ids = b"".join([self.seen_ids[w] for w in words])
                yield ids, " ".join([self.seen_names[w] for w in words])

    def _plain(self, text: str | None) -> bool:
        """Whether the text's words are those of its strings between white space, found by the fast pattern."""
        return bool(text) and self.splitter.usual and self.splitter.common.fullmatch(text) is not None and not (self.find_special and self.special_start in text)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one word's after another's; number of ids of each)."""
        ids, counts = zip(*(self.encoder.all_ids(words[at : at + TOGETHER]) for at in range(0, max(1, len(words)), TOGETHER)), strict=True)
        return np.concatenate(ids), np.concatenate(counts)

    def _together(self, texts: pa.Array, said: list[str | None], names: bool) -> tuple[list[int], list[pa.Array]]:
        """(places of the plain texts, [their ids, and if asked for what they decode to]). A word is encoded once for all
        texts: they are cut at white space, different strings of them into words, and what different words give is joined
        to strings and those to texts."""
        plain = [i for i, t in enumerate(said) if self._plain(t)]
        cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.take(pa.array(plain, pa.int64())).cast(pa.large_string())))
        strings, find = cut.flatten().dictionary_encode(), self.splitter.fast.findall
        found = [[s] if s.isalpha() else find(s) for s in map(str.lower, strings.dictionary.to_pylist())]
        words = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        ids, counts = self._ids_of(words.dictionary.to_pylist())
        borders = np.cumsum([0, *counts])
        columns = [(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(borders * 4), pa.py_buffer(ids.astype("<u4"))]), "")]
        if names:
            tokens = self.tokens.take(pa.array(ids))
            columns.append((pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), tokens), pa.scalar(" ", tokens.type)), " "))
        out = []
        for column, between in columns:
            for at, parts in ((offsets, words.indices), (cut.offsets, strings.indices)):
                column = pc.binary_join(pa.ListArray.from_arrays(at, column.take(parts)), pa.scalar(between, column.type))
            out.append(column)
        return plain, out

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode() of each text; words of plain texts are encoded once for all of them."""
        plain, (ids,) = self._together(texts, said := texts.to_pylist(), False)
        known = dict(zip(plain, ids.to_pylist(), strict=True))
        return [known[i] if i in known else self.encode(t) for i, t in enumerate(said)]

    def encode_decode_all(self, texts: pa.Array) -> list[tuple[bytes, str]]:
        """encode_decode() of each text, likewise."""
        plain, (ids, decoded) = self._together(texts, said := texts.to_pylist(), True)
        known = dict(zip(plain, zip(ids.to_pylist(), decoded.to_pylist(), strict=True), strict=True))
        return [known[i] if i in known else self.encode_decode(t) for i, t in enumerate(said)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit words."""
        return b"".join([p[0] for p in self._parts(text)]) if text else b""

    def encode_decode(self, text: str | None) -> tuple[bytes, str]:
        """The ids, and what the library's decode(ids, skip_special_tokens=False) gives for them."""
        parts = list(self._parts(text)) if text else []
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])


class LibraryCodec(Codec):
    """The same splitting and remembering; words not met before are encoded by the tokenizers library's model."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.seen_strings: dict[str, bytes] = {}
        self.older_strings: dict[str, bytes] = {}
        self.older_ids: dict[str, bytes] = {}
        self.symbols = dict(enumerate(byte_symbols()))

    def _new(self, word: str) -> bytes:
        """A word's ids by the library's own model, as the string of its bytes' symbols; visible ASCII is its own."""
        ids = [t.id for t in self.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols, tokenize, ids, counts = self.symbols, self.tokenize, [], []
        for word in words:
            tokens = tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(symbols))
            counts.append(len(tokens))
            ids += [t.id for t in tokens]
        return np.array(ids, np.int64), np.array(counts, np.int64)

    def _known(self, word: str) -> bytes | None:
        """Ids of a word that was met beside others in a string."""
        return self.seen_ids.get(word) or self.older_ids.get(word)

    def _part(self, word: str) -> bytes:
        ids = self.seen_ids.get(word)
        if ids is None:
            ids = self._known(word) or self.seen_strings.get(word) or self.older_strings.get(word) or self._new(word)
            if len(self.seen_ids) >= REMEMBERED // 2:
                self.older_ids, self.seen_ids = self.seen_ids, {}
            self.seen_ids[word] = ids
        return ids

    def _string(self, string: str) -> bytes:
        """Ids of a string without white space, by its words."""
        found = self.older_strings.get(string)
        if found is None:
            if string.isalpha():
                found = self._known(string) or self._new(string)
            else:
                found = b"".join([self._part(w) for w in self.splitter.fast.findall(string)])
        self.seen_strings[string] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """As no word spans white space, a text of common characters is encoded string by string. What is remembered is
        of two ages: the older half goes when the younger is full, but for what was met again."""
        if not text:
            return b""
        if not self.splitter.common.fullmatch(text) or (self.find_special and self.find_special.search(text)):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if len(self.seen_strings) >= REMEMBERED:
            self.older_strings, self.seen_strings = self.seen_strings, {}
        strings = text.lower().split()
        parts = list(map(self.seen_strings.get, strings))
        if None in parts:
            new, seen = self._string, self.seen_strings
            parts = [p or seen.get(s) or new(s) for p, s in zip(parts, strings, strict=True)]
        return b"".join(parts)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, put together while they have no more than GROUP_BYTES."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > GROUP_BYTES:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


_codecs: dict[str, Codec] = {}
_library_codecs: dict[str, LibraryCodec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def library_codec(path: str) -> LibraryCodec:
    if path not in _library_codecs:
        _library_codecs[path] = LibraryCodec(path)
    return _library_codecs[path]


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit words), decoded; one row for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in grouped(batches):
            both = c.encode_decode_all(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in both], pa.binary()), pa.array([x[1] for x in both], pa.string())], ["doc_id", "ids", "decoded"]
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, made in the task, so that no ids leave it."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for batch in grouped(batches):
            n, ids_sha, text_sha = [], [], []
            for ids, decoded in c.encode_decode_all(batch.column(1)):
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
