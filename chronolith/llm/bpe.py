"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merge
rules produce. It starts as one state with an arc to itself for every byte. Each
merge u v -> uv is applied as a gadget, in order: the state that u leads to is
copied without its arc on v (the pair never stays unmerged), u now leads to the
copy, and every state with an arc on u gets an arc on uv to where v led. All arcs
with one label lead to one state, so the automaton is deterministic and a state is
named by its label. Copies share their arcs with what they were copied from: a
label keeps which arcs its state lost and when, and the label (its right part)
whose state it branched off, which makes the machine linear in the number of
merges; a cell of the transition table is filled in the first time that it's read.

A byte string has one accepted path. Encoding a word follows the longest arcs first
and steps back from positions that turn out dead; as prefixes of accepted paths are
accepted and unique, each position is entered once, so the work is linear in the
word's length, also for words of a megabyte. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import tidy

TOKENIZER = "byte_bpe_50k.json"
#: The pattern of the byte-level pre-tokenizer (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker remembers the paths of this many words, and as many that it met before those.
WORDS_KEPT = 150_000
HEAD = 4
#: The same pattern for texts below U+0250, with its classes spelled out for the faster standard module.
LATIN = r" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
LATIN_CLASSES = {"L": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "N": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "S": " \\t-\\r\u0085\u00a0"}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes stand for themselves, others for 256, 257, ..."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of a list of merges (pairs of byte strings), with ids for labels."""

    START = -1

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.born = {i: -1 for t, i in vocab.items() if len(t) == 1}  # label -> time of its gadget
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.lost: dict[int, dict[int, int]] = {i: {} for i in [self.START, *self.born]}  # label -> arc that its state lost -> time
        for time, (u, v) in enumerate(merges):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v])
        self.ids = {t: i for t, i in vocab.items() if i in self.born}
        self.trie: dict[int, int] = {}  # (node, byte) -> node
        self.ends: dict[int, int] = {}  # node -> label
        for t, i in self.ids.items():
            node = 0
            for b in t:
                node = self.trie.setdefault(node << 8 | b, len(self.trie) + 1)
            self.ends[node] = i
        self.table: dict[int, bool] = {}
        self.heads: dict[bytes, tuple[tuple[tuple[int, int], ...], int]] = {}

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        if uv in self.born:
            return
        self.lost[u][v] = time  # u leads to a copy without the arc on v from now on
        self.lost[uv] = {}  # uv leads to where v led until now
        self.born[uv], self.left[uv], self.right[uv] = time, u, v

    def has_arc(self, state: int, label: int) -> bool:
        """Whether the final automaton has an arc on `label` from the state that label `state` leads to."""
        born, lost, until = self.born, self.lost, 2 * len(self.born)
        while True:
            since = born[label]
            while True:
                if lost[state].get(label, until) < until:
                    return False
                if state == self.START or born[state] <= since:
                    break
                until = min(until, born[state])  # before its birth, the state was its right part's
                state = self.right[state]
            if since < 0:
                return True
            until = min(until, since + 1)  # the gadget added the arc where there was one on its left part
            label = self.left[label]

    def _labels_at(self, word: bytes, at: int) -> tuple[tuple[int, int], ...]:
        """(length, label) of the vocabulary's strings that start at `at`, shortest first; those of the next HEAD bytes are kept."""
        key = word[at : at + HEAD]
        head = self.heads.get(key)
        if head is None:
            node, found = 0, []
            for n, b in enumerate(key, 1):
                if not (node := self.trie.get(node << 8 | b, 0)):
                    break
                if (label := self.ends.get(node)) is not None:
                    found.append((n, label))
            head = self.heads[key] = (tuple(found), node if len(key) == HEAD else 0)
        found, node = head
        if node:
            more, end, n, trie = None, at + HEAD, len(word), self.trie
            while end < n and (node := trie.get(node << 8 | word[end], 0)):
                end += 1
                if (label := self.ends.get(node)) is not None:
                    if more is None:
                        more = list(found)
                    more.append((end - at, label))
            if more is not None:
                return more
        return found

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The ids on the accepted path of `word`."""
        if (whole := self.ids.get(word)) is not None:
            return (whole,)
        n, table, heads, labels_at = len(word), self.table, self.heads, self._labels_at
        path, at, state = [], 0, self.START
        stack, dead = [], set()
        arcs, k = labels_at(word, 0), -1
        while True:
            if k == -1:
                k = len(arcs)
            while k:
                k -= 1
                size, label = arcs[k]
                if dead and at + size in dead:
                    continue
                cell = (state + 1) << 32 | label
                ok = table.get(cell)
                if ok is None:
                    ok = table[cell] = self.has_arc(state, label)
                if ok:
                    path.append(label)
                    if at + size == n:
                        return tuple(path)
                    stack.append((at, state, arcs, k))
                    at, state = at + size, label
                    head = heads.get(word[at : at + HEAD])
                    arcs = head[0] if head is not None and not head[1] else labels_at(word, at)
                    k = -1
                    break
            else:
                dead.add(at)
                at, state, arcs, k = stack.pop()
                path.pop()


def _vocabulary(d: dict) -> dict[bytes, int]:
    pre = d["pre_tokenizer"]
    if d["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or d["normalizer"]:
        raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
    byte = byte_letters()
    return {bytes(byte[c] for c in t): i for t, i in d["model"]["vocab"].items()}


class Decoder:
    """Ids to texts: the labels alone."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        self.labels = {i: t for t, i in _vocabulary(d).items()} | {t["id"]: t["content"].encode() for t in d["added_tokens"]}

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Texts to ids, for a tokenizer file of the byte-level BPE kind."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        vocab, byte = _vocabulary(d), byte_letters()
        raw = lambda s: bytes(byte[c] for c in s)
        pairs = (p if isinstance(p, list) else p.split(" ") for p in d["model"]["merges"])
        self.automaton = Automaton(vocab, [(raw(a), raw(b)) for a, b in pairs])
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.split = regex.compile(SPLIT)
        self.latin = re.compile(LATIN.format(**LATIN_CLASSES))
        self.beyond = re.compile("[^\0-\u024f]")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.added[part])
                continue
            known, meet = self.words.get, self._meet
            for w in (self.split if self.beyond.search(part) else self.latin).findall(part):
                out += known(w) or meet(w)
        return out

    def _meet(self, word: str) -> tuple[int, ...]:
        """The ids of a word that isn't among the latest ones."""
        ids = self.older.get(word) or self.automaton.encode(word.encode())
        if len(word) <= 64:
            if len(self.words) >= WORDS_KEPT:
                self.older.clear()
                self.older.update(self.words)
                self.words.clear()
                if len(self.automaton.table) > 4 * WORDS_KEPT:
                    self.automaton.table.clear()
                if len(self.automaton.heads) > WORDS_KEPT:
                    self.automaton.heads.clear()
            self.words[word] = ids
        return ids


_made: dict[str, dict[type, Encoder | Decoder]] = {}


def _of(kind: type, spec):
    """The worker's encoder or decoder of one tokenizer file: compiled once a process, not once a task."""
    if spec.id not in _made:
        _made.clear()
    own = _made.setdefault(spec.id, {})
    if kind not in own:
        own[kind] = kind(spec.data)
    return own[kind]


class Spec:
    """A tokenizer file's bytes: read by the driver, broadcast (about 1.6 MB, whatever the data)."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            self.shared = spark.sparkContext.broadcast(f.read())
        self.id = path

    @property
    def data(self) -> bytes:
        return self.shared.value


def _map(df: DataFrame, column: str, added: list[tuple[str, T.DataType, pa.DataType]], f) -> DataFrame:
    """All columns of `df` and the added ones, f(value) of `column`; rows are taken in pieces, so long texts don't add up."""
    new = [name for name, _, _ in added]
    schema = T.StructType([x for x in df.schema.fields if x.name not in new] + [T.StructField(name, kind) for name, kind, _ in added])
    names = [x.name for x in schema.fields[: -len(added)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = [f(x) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array([g[i] for g in got], arrow) for i, (_, _, arrow) in enumerate(added))], [*names, *new])

    return df.mapInArrow(tidy(run), schema)


IDS = (T.ArrayType(T.IntegerType(), False), pa.list_(pa.field("element", pa.int32(), False)))
TEXT = (T.StringType(), pa.string())


def encode(df: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """`df` with the ids (array<int>) of every whole text; null text has no ids, as ''.

    The ids are those of the tokenizers library without special tokens added: an
    added token's string in a text becomes its id. A column named `out` is replaced.
    """
    spec = Spec(df.sparkSession, path)
    return _map(df, column, [(out, *IDS)], lambda x: (_of(Encoder, spec).encode(x or ""),))


def decode(df: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of every row's ids; null or no ids: ''. An unknown id raises."""
    spec = Spec(df.sparkSession, path)
    return _map(df, column, [(out, *TEXT)], lambda x: (_of(Decoder, spec).decode(x or ()),))


def encode_and_decode(df: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encode`, then `decode` of its ids, in one pass: a task needs one worker process, not two."""
    spec = Spec(df.sparkSession, path)

    def both(x):
        found = _of(Encoder, spec).encode(x or "")
        return found, _of(Decoder, spec).decode(found)

    return _map(df, column, [(ids, *IDS), (decoded, *TEXT)], both)
