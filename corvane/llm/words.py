"""Word-wise encoding: the ids of a text are the ids of its words, one after another.

A *word* here is a stretch of text that starts at the text's start, or at a space between
two characters that are not white space.  Neither vocabulary's pre-tokenizer can match across
such a place, so encoding words one by one and joining the ids gives exactly what the
tokenizers library gives for the whole text.  Words repeat far more often than texts do, so
each distinct word is encoded once for a batch, and a bounded table keeps them between batches.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are cut here.  Python's white space contains that of the tokenizers, so a place that
#: is cut has no white space on either side for them as well; a place left uncut does no harm.
WORD_START = re.compile(r"(?<=[^\s\u180e])(?= [^\s\u180e])")
#: White space that is not a lone space between two words, as pyarrow's RE2 sees it.
ODD_SPACE = r"(^|[\s\v\x1c-\x1f\x85\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])([ ]|$)|[ ]([\s\v\x1c-\x1f\x85\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])"
BLANK, NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
#: Texts are handled in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: Distinct words that a worker remembers; it forgets all of them when there are more.
TABLE_WORDS = 500_000


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first, count) of consecutive runs of texts, each of about `most` bytes or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes.astype(np.int64)), 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, last - first
        first = last


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the number of words of each.  Null and empty texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    first = np.zeros(len(flat), bool)
    starts = np.cumsum(lens) - lens
    first[starts] = True
    flat = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(BLANK, flat, NOTHING))
    if not odd.any():
        return flat, lens
    parts, lens = [], lens.copy()
    run = 0
    for i in np.flatnonzero(odd):
        parts.append(flat.slice(starts[run], starts[i] - starts[run]))
        words = WORD_START.split(texts[int(i)].as_py()) if texts[int(i)].as_py() else []
        parts.append(pa.array(words, pa.large_string()))
        lens[i] = len(words)
        run = i + 1
    if run < len(texts):
        parts.append(flat.slice(starts[run]))
    return pa.concat_arrays(parts), lens


def gather(ids: list[bytes], at: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id lists of the words at[0], at[1], ... joined, and the number of ids of each text."""
    lens = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    return gather_flat(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lens) - lens, lens, at, n_words)


def gather_flat(table: np.ndarray, begin: np.ndarray, lens: np.ndarray, at: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As gather, of words whose ids lie in one array."""
    each = lens[at]
    ends = np.concatenate([[0], np.cumsum(each)])
    index = np.repeat(begin[at] - ends[:-1], each) + np.arange(ends[-1])
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    return table[index], ends[bounds[1:]] - ends[bounds[:-1]]


class WordCoder:
    """Encodes texts by a tokenizer file of the tokenizers library, each distinct word once."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table: dict[str, bytes] = {}
        self.most = table_words

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in out]

    def lookup(self, words: list[str]) -> list[bytes]:
        """As encode_words, of distinct words, through the table."""
        table = self.table
        missing = [w for w in words if w not in table]
        if missing:
            if len(table) + len(missing) > self.most:
                missing = words
                table.clear()
            for i in range(0, len(missing), 8192):
                part = missing[i : i + 8192]
                table.update(zip(part, self.encode_words(part)))
        return [table[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of ids of each text."""
        words, n_words = split_words(texts)
        coded = words.dictionary_encode()
        return gather(self.lookup(coded.dictionary.to_pylist()), coded.indices.to_numpy(), n_words)


class EndMarkedCoder(WordCoder):
    """For vocabularies that lower-case, drop white space and mark the last piece of a part.

    Plain texts (see ODD) are lower-cased and cut into the parts of PARTS by Arrow kernels; only
    parts that the worker's table lacks are encoded, in one call, where the mark on the last
    piece of each tells them apart.  Other texts go to the library word by word.
    """

    #: Characters with one class and one lower case in every library make plain texts; contractions
    #: and special tokens don't.
    ODD = r"[^\t\n\r\x20-\x26\x28-\x7e\xa1-\x{12f}\x{131}-\x{148}\x{14a}-\x{17e}]|<\|"
    #: Fixed value: the parts that the vocabulary file's pre-tokenizer cuts.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MARK = "</w>"

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        super().__init__(path, table_words)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for piece, i in vocab.items() if piece.endswith(self.MARK)]] = True
        self.whole = WordCoder(path, table_words // 4)

    def encode_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return super().encode_words(words)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.ODD)
        plain = pc.if_else(odd, NOTHING, texts)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), r"([^\s\p{L}\p{N}]+|\p{N})", r" \1 "))
        flat = parts.flatten()
        filled = pc.not_equal(flat, NOTHING)
        owner = parts.value_parent_indices().to_numpy()[filled.to_numpy(zero_copy_only=False)]
        coded = flat.filter(filled).dictionary_encode()
        ids, lens = gather(self.lookup(coded.dictionary.to_pylist()), coded.indices.to_numpy(), np.bincount(owner, minlength=len(texts)))
        if not (at := np.flatnonzero(odd.to_numpy(zero_copy_only=False))).size:
            return ids, lens
        more, each = self.whole.encode(texts.take(pa.array(at)))
        out = np.split(ids, np.cumsum(lens)[:-1])
        for i, x in zip(at, np.split(more, np.cumsum(each)[:-1])):
            out[i] = x
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))


class ByteCoder:
    """For byte-level vocabularies without a normaliser: whole texts by tiktoken, which reads the
    same vocabulary as ranks, where every character's class is beyond doubt (see PLAIN);
    other texts go to the tokenizers library.  Both give the same ids."""

    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")
    #: Fixed value: the pattern of byte-level pre-tokenizers.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = {piece_bytes(p): i for p, i in self.tokenizer.get_vocab().items() if p not in special}
        self.fast = tiktoken.Encoding("byte level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def one(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.PLAIN.fullmatch(text):
            return bytes(self.fast._core_bpe.encode_to_tiktoken_buffer(text, self.special))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def piece_bytes(piece: str) -> bytes:
    """The bytes of a byte-level piece: printable Latin-1 stands for itself, other bytes for U+0100 and on."""
    return bytes(map(_byte_of().__getitem__, piece))


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def coder(path: str, kind: type = WordCoder):
    """One for each worker process, file and kind."""
    return kind(path)


def end_marked(path: str) -> bool:
    """Whether the file's pieces mark the ends of parts as EndMarkedCoder expects."""
    import json

    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    cut = x["pre_tokenizer"] or {}
    parts = [p.get("pattern", {}).get("Regex") for p in cut.get("pretokenizers", [])]
    steps = [n["type"] for n in (x["normalizer"] or {}).get("normalizers", [])]
    return x["model"].get("end_of_word_suffix") == EndMarkedCoder.MARK and EndMarkedCoder.PARTS in parts and steps == ["NFC", "Replace", "Lowercase"]


def text_coder(path: str) -> WordCoder:
    return coder(path, EndMarkedCoder if end_marked(path) else WordCoder)
