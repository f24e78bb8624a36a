"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens, and it accepts exactly those sequences that the merges make of some word.
At first it has the letters only, in one state with an arc for each. Every merge ``(u, v)``, in order,
adds its gadget: the state behind ``u`` is copied without its arc for ``v`` (so that ``u v`` cannot stand
any more), and every state that can read ``u`` gets an arc for the new token ``u v``, to the state
behind ``v``. All arcs of a token lead to one state, so the automaton is deterministic by construction,
and what a state lacks is all there is to store.

*Arcs as intervals.* A token is readable where its left part was when it was made. Tokens numbered
along the tree of left parts, younger children first, make the arcs that one gadget takes away an
interval of numbers: the token itself and the younger children's subtrees. A state is a short sorted
list of missing intervals, and a transition is a look into that list.

*Encoding.* The automaton walks through a word by the longest token, found in a trie, that its state has
an arc for, and steps back where no arc leads on. Every prefix of a word has one accepted path, since a
word has one tokenization: a place that was left once is closed for good, and the walk stays linear.
Decoding emits the labels of the arcs.

Documents are independent: no shuffle. Words repeat, so a worker keeps a bounded table of encoded ones.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import blocks

#: Characters encoded at a time.
BLOCK_CHARS = 2_000_000
#: Encoded words, and texts between blanks, kept per Python worker; beyond it a table starts anew.
KEPT = 500_000
#: Longer ones are encoded each time instead of being kept.
KEPT_LENGTH = 40
#: Fixed value: what marks the last letter of a word in the vocabulary.
WORD_END = "</w>"
#: Characters whose lower case is one character, that compose with no neighbour and are no white space
#: but the blank: for texts of these, lower case and the split pattern are all the vocabulary's rules do.
_PLAIN = r"[\x21-\x7e¡-įı-ɏ]*"

State = tuple[array, array]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is
    printable, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 256
    for byte in range(256):
        if byte in shown:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class Automaton:
    """The automaton of one list of merges ``(left, right)`` over letters, both as strings.

    ``ids`` maps tokens to ids. ``behind[t]`` is the state behind token ``t``: the starts and ends of its
    missing intervals of token numbers.
    """

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]):
        place = {t: i for i, t in enumerate(dict.fromkeys([*(set(ids) - {a + b for a, b in merges}), *(a + b for a, b in merges)]))}
        self.tokens = list(place)
        self.ids = [ids[t] for t in self.tokens]
        births: list[list[int]] = [[] for _ in self.tokens]  # of children, by left part
        children: list[list[int]] = [[] for _ in self.tokens]
        for k, (left, right) in enumerate(merges):
            births[place[left]].append(k)
            children[place[left]].append(place[left + right])
        self.number, subtree_end = self._numbered(children, {place[a + b] for a, b in merges})
        self.start: State = (array("i"), array("i"))
        self.behind: list[State] = [self.start] * len(self.tokens)
        self.dead: set[int] = set()
        for k, (left, right) in enumerate(merges):
            u, v, new = place[left], place[right], place[left + right]
            if u in self.dead or v in self.dead or not self._readable(self.behind[u], v):
                self.dead.add(new)  # its parts never stand side by side
                continue
            young = bisect_left(births[v], k)
            end = subtree_end[children[v][young]] if young < len(children[v]) else self.number[v] + 1
            after = self.behind[v]
            self.behind[u] = self._without(self.behind[u], self.number[v], end)
            self.behind[new] = after
        self._trie()

    def _numbered(self, children: list[list[int]], made: set[int]) -> tuple[list[int], list[int]]:
        """Preorder numbers along the tree of left parts, younger children first; ends of subtrees."""
        number, end, count = [0] * len(children), [0] * len(children), 0
        todo = [(t, False) for t in range(len(children)) if t not in made]
        while todo:
            token, done = todo.pop()
            if done:
                end[token] = count
                continue
            number[token] = count
            count += 1
            todo.append((token, True))
            todo.extend((c, False) for c in children[token])  # popped from the youngest
        return number, end

    def _readable(self, state: State, token: int) -> bool:
        starts, ends = state
        n = self.number[token]
        at = bisect_right(starts, n)
        return not at or ends[at - 1] <= n

    @staticmethod
    def _without(state: State, start: int, end: int) -> State:
        """The copy of a state that lacks one more interval; those inside it are swallowed."""
        starts, ends = state
        first = bisect_left(starts, start)
        last = bisect_left(starts, end)
        return starts[:first] + array("i", [start]) + starts[last:], ends[:first] + array("i", [end]) + ends[last:]

    def _trie(self) -> None:
        """Arcs ``node << 9 | letter`` over the letters of tokens; 256 is added for a word's last one."""
        letter = {c: b for b, c in enumerate(byte_letters())}
        self.arcs: dict[int, int] = {}
        self.found = [-1]
        for token, text in enumerate(self.tokens):
            body, last = (text[: -len(WORD_END)], 256) if text.endswith(WORD_END) else (text, 0)
            if token in self.dead or not body or any(c not in letter for c in body):
                continue
            node = 0
            for i, c in enumerate(body):
                key = node << 9 | letter[c] | (last if i == len(body) - 1 else 0)
                if key not in self.arcs:
                    self.arcs[key] = len(self.found)
                    self.found.append(-1)
                node = self.arcs[key]
            self.found[node] = token
        self.lengths = [len(t.removesuffix(WORD_END)) for t in self.tokens]

    def _onward(self, letters: list[int], at: int, state: State, closed: bytearray) -> list[int]:
        """Tokens that the state reads from ``at`` on, shortest first, and that end at no closed place."""
        arcs, found, number = self.arcs, self.found, self.number
        starts, ends = state
        node, tokens = 0, []
        for j in range(at, len(letters)):
            node = arcs.get(node << 9 | letters[j])
            if node is None:
                break
            token = found[node]
            if token >= 0 and not closed[j + 1]:
                before = bisect_right(starts, number[token])
                if not before or ends[before - 1] <= number[token]:
                    tokens.append(token)
        return tokens

    def encode(self, word: bytes) -> list[int]:
        """The token ids of one word of one byte or more."""
        letters = list(word)
        letters[-1] |= 256
        closed = bytearray(len(letters) + 1)
        at, path = 0, []
        onward = [self._onward(letters, 0, self.start, closed)]
        while at < len(letters):
            if onward[-1]:
                token = onward[-1].pop()
                if closed[at + self.lengths[token]]:
                    continue
                at += self.lengths[token]
                path.append(token)
                onward.append(self._onward(letters, at, self.behind[token], closed))
            else:
                closed[at] = 1
                onward.pop()
                at -= self.lengths[path.pop()]
        return [self.ids[t] for t in path]


class TextEncoder:
    """Ids of texts (little-endian unsigned 32-bit), for one tokenizer file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        pattern = held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.matches, self.plain = regex.compile(pattern).findall, regex.compile(_PLAIN).fullmatch
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        self.automaton = Automaton(held["model"]["vocab"], [(a, b) for a, b in held["model"]["merges"]])
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in held["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("I", self.automaton.encode(word)).tobytes()
            if len(word) <= KEPT_LENGTH:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if self.plain(chunk):
            low = chunk.lower()
            words = [low.encode()] if low.isalpha() else [w.encode() for w in self.matches(low)]
        else:
            words = [bytes(map(self.byte.__getitem__, w)) for w, _ in self.split(self.normalize(chunk))]
        ids = b"".join(map(self._word, words))
        if len(chunk) <= KEPT_LENGTH:
            self.chunks[chunk] = ids
        return ids

    def _segment(self, text: str) -> bytes:
        kept = self.chunks.get
        out = []
        for chunk in text.replace("\n", " ").split(" "):
            ids = kept(chunk)
            out.append(self._chunk(chunk) if ids is None else ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """No match of the split pattern holds a blank or a line feed, and nothing composes over one, so
        texts are cut there. Strings of special tokens are taken out first, from the text as it is."""
        for kept in (self.words, self.chunks):
            if len(kept) > KEPT:
                kept.clear()
        if "<|" not in text:
            return self._segment(text)
        parts = self.specials(text)
        return b"".join(self.special[p] if i % 2 else self._segment(p) for i, p in enumerate(parts))


def arc_labels(path: str) -> pa.Array:
    """What the arc of each id is labelled with, special tokens included."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    labels = {i: t for t, i in held["model"]["vocab"].items()} | {t["id"]: t["content"] for t in held["added_tokens"]}
    return pa.array([labels.get(i) for i in range(max(labels) + 1)], pa.string())


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One automaton per Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids binary)`` of every text, ids as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a tokenizer file with a byte-level BPE model, word ends and a split
    pattern. Special tokens that stand in a text are taken as such, none is added, nothing is truncated.
    Null and empty texts give no ids; a null id and repeated rows are rows like others; an empty table
    gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for begin, stop in blocks(("" if t is None else t for t in texts.to_pylist()), BLOCK_CHARS):
                some = [texts_of.encode(t) if t else b"" for t in texts[begin:stop].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:stop], pa.array(some, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded string``: the labels of the ids' arcs, joined by blanks as the file,
    which names no decoder, asks for (null for null ids)."""
    kept = [f.name for f in encoded.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = arc_labels(tokenizer)
        for whole in batches:
            ids = whole.column("ids")
            for begin, stop in blocks(("" if i is None else i for i in ids.to_pylist()), 2 * BLOCK_CHARS):
                batch = whole.slice(begin, stop - begin)
                rows = batch.column("ids").to_pylist()
                flat = np.frombuffer(b"".join(r or b"" for r in rows), "<u4")
                cuts = np.cumsum([0, *(len(r or b"") // 4 for r in rows)], dtype=np.int32)
                mask = pa.array([r is None for r in rows])
                arcs = pa.ListArray.from_arrays(pa.array(cuts), labels.take(pa.array(flat)), mask=mask)
                yield pa.RecordBatch.from_arrays([*batch.columns, pc.binary_join(arcs, " ")], [*kept, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")
