"""BPE encoding and decoding (operator 10) by prefix-sharing trie traversal.

A word's byte-pair encoding is decided prefix by prefix: the encoding of a prefix is the encoding of a shorter prefix
and one last token, the only suffix token that may follow that shorter prefix's own last token. Distinct words are put
in order, which is a depth-first walk of their trie: the path shared with the word before keeps its states (last token
and encoding per prefix), so each trie node's state is computed once. Words without their last character share states;
the last character carries the end-of-word mark, so each word ends in a leaf of its own.

Texts are cut at white space; a bounded cache maps each distinct cut to its encoding, so a text costs one split and one
join. Everything is done by row inside a task: no shuffle, memory bounded by one Arrow batch and ``CACHE`` entries.

Defined results: a null or empty text has no tokens and decodes to the empty string; repeated rows are encoded one by
one; an empty table gives an empty table; only the key and ``text`` are read. Strings of special tokens in a text are
encoded as those tokens, as the tokenizers library does by default.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, sliced

#: Entries of each cache of a Python worker; a full cache starts anew.
CACHE = 500_000
#: Characters of text whose new words are put into one trie.
BATCH_CHARS = 1_000_000
END = "</w>"

_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_WHITE = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_LATIN = re.compile(r"[\x21-\x7e\xa1-\xff]+\Z")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


def default_path() -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> dict[int, str]:
    """The printable character of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    n = 256
    for b in range(256):
        if b not in out:
            out[b] = chr(n)
            n += 1
    return out


class TrieEncoder:
    """Encodings of distinct words (strings of byte characters) with a merge list whose tokens have one merge each."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.vocab = vocab
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        rank = {}
        self.made: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for i, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.made[x, y] = z
            self.halves[z] = (x, y)
            rank[z] = i + 1
        self.rank = rank  # 0 for symbols that no merge makes
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        # a token that its own string isn't encoded to is in no encoding
        stand = {x: t for x, t in vocab.items() if self.stands(t)}
        inner = {x: t for x, t in stand.items() if not x.endswith(END)}
        final = {x[: -len(END)]: t for x, t in stand.items() if x.endswith(END)}
        self.inner, self.final = inner.get, final.get
        self.reach, self.reach_end = self._reach(inner).get, self._reach(final).get

    @staticmethod
    def _reach(tokens: dict[str, int]) -> dict[str, int]:
        """The longest token by its last two characters."""
        out: dict[str, int] = {}
        for x in tokens:
            out[x[-2:]] = max(len(x), out.get(x[-2:], 2))
        return out

    def _apart(self, a: int, b: int, together: bool) -> bool:
        """Whether no merge joins the seam between ``a`` and ``b`` while their strings are built.

        Both are taken apart along the seam, the later-made one first; the seam falls if a pair of parts merges before
        the step that made either of them. ``together``: the merge of ``a`` and ``b`` themselves doesn't count.
        """
        rank, halves, made = self.rank, self.halves, self.made
        ra, rb = rank.get(a, 0), rank.get(b, 0)
        limit = None  # merges from this rank on come too late
        while True:
            z = None if together else made.get((a, b))
            together = False
            if z is not None and (limit is None or rank[z] < limit):
                return False
            if ra == 0 and rb == 0:
                return True
            if ra >= rb:
                limit = ra if limit is None else min(limit, ra)
                a = halves[a][1]
                ra = rank.get(a, 0)
            else:  # of equal ranks the left pair merges first
                limit = rb + 1 if limit is None else min(limit, rb + 1)
                b = halves[b][0]
                rb = rank.get(b, 0)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether ``b`` can stand after ``a`` in an encoding."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 4 * CACHE:
                self.fits.clear()
            known = self.fits[a, b] = self._apart(a, b, False)
        return known

    def stands(self, t: int) -> bool:
        """Whether the token is what its own string encodes to."""
        known = self.whole.get(t)
        if known is None:
            pair = self.halves.get(t)
            known = pair is None or (self.stands(pair[0]) and self.stands(pair[1]) and self._apart(*pair, True))
            self.whole[t] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct non-empty words of byte characters.

        ``last[i]`` and ``codes[i]`` are the last token and the encoding of the path's first ``i`` characters, ``cuts[i]``
        where that token starts. A longer prefix mostly extends the last token, so that start is tried first; the one
        token that fits is found whatever the order.
        """
        out: dict[str, tuple[int, ...]] = {}
        inner, final = self.inner, self.final
        fits, fit = self.fits.get, self.may_follow
        reach, reach_end = self.reach, self.reach_end
        last, codes, cuts = [-1], [()], [0]
        path = ""
        for word in sorted(words):
            n = len(word)
            top = min(len(last) - 1, n - 1)
            i = 0
            while i < top and path[i] == word[i]:
                i += 1
            del last[i + 1 :], codes[i + 1 :], cuts[i + 1 :]
            path = word
            while i < n:
                i += 1
                get = inner if i < n else final
                j = cuts[i - 1]
                t = get(word[j:i])
                if t is not None and j:
                    ok = fits((last[j], t))
                    if not (fit(last[j], t) if ok is None else ok):
                        t = None
                if t is None:
                    far = reach(word[i - 2 : i], 2) if i < n else reach_end(word[i - 2 : i], 2)
                    for j in range(i - far if i > far else 0, i):
                        t = get(word[j:i])
                        if t is not None:
                            if j == 0:
                                break
                            ok = fits((last[j], t))
                            if fit(last[j], t) if ok is None else ok:
                                break
                    else:
                        raise ValueError(f"no encoding of {word[:i]!r}")
                if i < n:
                    last.append(t)
                    codes.append((*codes[j], t))
                    cuts.append(j)
                else:
                    out[word] = (*codes[j], t)
        return out


class Codec:
    """A text's cuts (by white space) and what each becomes.

    ``make``: "bytes" keeps a cut's ids as little-endian numbers, "texts" its ids and tokens as strings. ``engine``:
    "trie" encodes new words by the traversal above, "library" by the tokenizers library's model.
    """

    def __init__(self, path: str, make: str, engine: str = "trie"):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if engine == "trie":
            self.encode = TrieEncoder(spec["model"]["vocab"], spec["model"]["merges"]).encode_words
        else:
            model = self.lib.model.tokenize
            self.encode = lambda words: {w: [t.id for t in model(w)] for w in words}
        names = {i: s for s, i in spec["model"]["vocab"].items()} | {i: s for s, i in self.special.items()}
        numbers = {i: str(i) for i in names}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes = {b: ord(c) for b, c in byte_chars().items()}
        self.make = {
            "bytes": lambda ids: array("I", ids).tobytes(),
            "texts": lambda ids: (" ".join([numbers[i] for i in ids]), " ".join([names[i] for i in ids])),
        }[make]
        self.cache: dict[str, object] = {}
        self.most = CACHE * 7 // 5 if make == "bytes" else CACHE  # ids as bytes are small

    def pieces(self, cut: str) -> list[str]:
        """The pre-tokenizer's words of a text without white space, as byte characters."""
        if cut.isascii():
            if cut.isalpha():
                return [cut.lower()]
            return _PIECES.findall(cut.lower()) if cut.isprintable() else self._by_library(cut)
        if not _LATIN.match(cut):
            return self._by_library(cut)
        low, table = cut.lower(), self.bytes
        found = (low,) if cut.isalpha() else _PIECES.findall(low)
        return [p if p.isascii() else p.encode().decode("latin-1").translate(table) for p in found]

    def _by_library(self, cut: str) -> list[str]:
        """The library's own normalizer and pre-tokenizer, for whatever isn't plain."""
        return [p for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(cut))]

    def _learn(self, new: set[str]) -> None:
        """Encode new cuts. What is made here has no cycles, so the collector is kept from walking it."""
        on = gc.isenabled()
        gc.disable()
        try:
            self._encode(new)
        finally:
            if on:
                gc.enable()

    def _encode(self, new: set[str]) -> None:
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
        plain: dict[str, str] = {}
        mixed: dict[str, list] = {}
        special, pieces = self.special, self.pieces
        for cut in new:
            if cut.isalpha() and cut.isascii():
                plain[cut] = cut.lower()
            elif "<|" in cut and self.cut_special:
                mixed[cut] = row = []
                for x in self.cut_special.split(cut):
                    row += [special[x]] if x in special else pieces(x) if x else []
            else:
                mixed[cut] = pieces(cut)
        wanted = set(plain.values())
        for row in mixed.values():
            wanted.update(row)
        if special:
            wanted.difference_update(special.values())
        words = self.encode(wanted)
        words.update((i, (i,)) for i in special.values())
        make, cache = self.make, self.cache
        for cut, w in plain.items():
            cache[cut] = make(words[w])
        for cut, row in mixed.items():
            cache[cut] = make([i for w in row for i in words[w]])

    def values(self, texts: list[str | None]) -> Iterator[list]:
        """Per text what its cuts become, in order."""
        at = 0
        while at < len(texts):
            end, size, split, found, new = at, 0, [], [], set()
            get = self.cache.get
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH_CHARS):
                size += len(texts[end] or "")
                words = self._split(texts[end])
                row = list(map(get, words))
                gaps = [(i, words[i]) for i, v in enumerate(row) if v is None]
                new.update([w for _, w in gaps])
                split.append(gaps)
                found.append(row)
                end += 1
            if new:
                self._learn(new)
            for gaps, row in zip(split, found, strict=True):
                for i, w in gaps:
                    row[i] = get(w)
                yield row
            at = end

    @staticmethod
    def _split(text: str | None) -> list[str]:
        if not text:
            return []
        if _SEPARATORS.search(text):  # str.split would drop these, which are no white space to the tokenizer
            return [x for x in _WHITE.split(text) if x]
        return text.split()


#: Of one Python worker.
_CODECS: dict = {}


def codec(path: str, make: str, engine: str = "trie") -> Codec:
    key = (path, make, engine)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def bpe_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The general operator: per document its ids and the decoded text."""
    return _encoded(docs, key, text, path or default_path(), full=True)


def bpe_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document: n_tokens and the hashes of its ids and of the decoded text."""
    return _encoded(docs, key, text, path or default_path(), full=False)


def _encoded(docs: DataFrame, key: str, text: str, path: str, full: bool) -> DataFrame:
    kind = dict(docs.select(key).dtypes)[key]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, "texts")
        for b in sliced(batches):
            n, first, second = [], [], []
            for row in c.values(b.column(1).to_pylist()):
                ids, out = " ".join([x[0] for x in row]), " ".join([x[1] for x in row])
                n.append(ids.count(" ") + 1 if ids else 0)
                if full:
                    first.append(ids)
                    second.append(out)
                else:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(out.encode()).hexdigest())
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [key, "n_tokens", *(("ids", "decoded") if full else ("ids_sha256", "decoded_sha256"))]
    schema = f"`{key}` {kind}, n_tokens long, {names[2]} string, {names[3]} string"
    return docs.select(key, text).mapInArrow(task, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read(spark, sf_dir, "documents"))
