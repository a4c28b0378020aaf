"""Tokenization by a deterministic automaton compiled from the merges of a BPE over bytes.

The automaton reads token labels. It starts as one state that loops on all 256 bytes (and, for vocabularies that mark
the end of a word, on the 256 bytes that end one), and each merge
``(u, v) -> w`` is applied to it as a gadget:

* the state that ``u`` leads to is copied without its arc ``v``, and ``u`` leads to the copy, so that
  ``u v`` can no longer be read,
* every state with an arc ``u`` gets an arc ``w``, which leads where ``v`` led.

After the last merge the automaton accepts exactly the label sequences that the merges produce, one for
each byte string. All arcs of a label lead to one state, and the arcs of a state only grow after
it was made, so a state is stored as (parent, removed label, time), not as a list of 50,000 arcs, and the
transition table is filled as it is used. A word is encoded by following the arcs whose labels spell it:
every prefix has one path, so one table look-up per candidate arc decides. Decoding emits the arcs' labels.

How a text is normalised and split into words is read from the tokenizer's file; what is not known there is refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable
from typing import NamedTuple

import regex

#: Distinct words remembered by each Python worker; beyond it the memory starts anew.
WORD_MEMORY = 400_000

#: Bytes of a word that is remembered.
WORD_BYTES = 64


def printable_bytes() -> dict[str, int]:
    """The published byte alphabet of byte-level BPE files: character -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary(NamedTuple):
    """What a tokenizer's file says; ``key`` is a hash of all of it.

    ``base`` is 256, or 512 where the end of a word is marked. ``merges`` are pairs of labels, ``ids`` the token id of each label.
    ``steps`` are the normalisations, in order, as (kind, pattern, replacement).
    """

    merges: list[tuple[int, int]]
    ids: list[int]
    pattern: str
    base: int = 256
    steps: tuple[tuple[str, str, str], ...] = ()
    key: str = ""


def _lowered(text: str) -> str:
    """Small letters, letter by letter: a sigma at the end of a word is like any other."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def _step(kind: str, pattern: str, by: str) -> Callable[[str], str]:
    if kind == "Lowercase":
        return _lowered
    if kind == "Replace":
        found = regex.compile(pattern)
        return lambda t: found.sub(lambda _: by, t)
    return lambda t: unicodedata.normalize(kind, t)


class MergeAutomaton:
    """Compiled from a list of merges; see the module's text.

    Labels below ``base`` are bytes, those from 256 on bytes that end a word; label base + k is the result of merge k.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        merges, ids, pattern, base = vocabulary[:4]
        self.base, self.steps = base, [_step(*x) for x in vocabulary.steps]
        n = base + len(merges)
        self.left = [0] * n
        self.ids, self.pattern = ids, regex.compile(pattern)
        # texts of labels are strings whose characters are the labels of single bytes
        self.spelled: list[str] = [chr(b) for b in range(base)]
        self.leads = [0] * n
        self.made, self.parent, self.removed = [-1], [0], [-1]
        self.live = [True] * base
        for k, (u, v) in enumerate(merges):
            self._gadget(k, u, v)
        self.arcs: dict[int, int] = {}
        self.prefixes: dict[str, int] = {}
        for label, text in enumerate(self.spelled):
            if self.live[label]:
                for j in range(1, len(text)):
                    self.prefixes.setdefault(text[:j], -1)
        # labels of the same text: only one of them lies on the path, so the others are tried as well
        self.twins: dict[str, list[int]] = {}
        for label, text in enumerate(self.spelled):
            if self.live[label]:
                if self.prefixes.get(text, -1) >= 0:
                    self.twins.setdefault(text, []).append(label)
                else:
                    self.prefixes[text] = label
        self.words: dict[str, tuple[int, ...]] = {}

    def _gadget(self, k: int, u: int, v: int) -> None:
        w, target = self.base + k, self.leads[u]
        self.left[w] = u
        self.spelled.append(self.spelled[u] + self.spelled[v])
        usable = self.live[u] and self.live[v] and self._has(target, v)
        self.live.append(usable)
        if usable:
            self.leads[w] = self.leads[v]
            self.made.append(k)
            self.parent.append(target)
            self.removed.append(v)
            self.leads[u] = len(self.made) - 1

    def _has(self, state: int, label: int) -> bool:
        """Whether the state has an arc of this label: back through the gadgets that made the two."""
        made, removed, parent, left, base = self.made, self.removed, self.parent, self.left, self.base
        while True:
            since = made[state]
            if label >= base and label - base >= since:
                label = left[label]
            elif since < 0:
                return True
            elif label == removed[state]:
                return False
            else:
                state = parent[state]

    def step(self, state: int, label: int) -> int:
        """The transition table: the next state, or -1."""
        key = state << 20 | label
        to = self.arcs.get(key)
        if to is None:
            to = self.leads[label] if self._has(state, label) else -1
            if len(self.arcs) > 4 * WORD_MEMORY:
                self.arcs.clear()
            self.arcs[key] = to
        return to

    def symbols(self, word: str) -> str:
        """The labels of the bytes of a word, the last one marked where ends of words are."""
        s = word.encode("utf-8").decode("latin-1")
        return s if self.base == 256 or not s else s[:-1] + chr(256 + ord(s[-1]))

    def labels(self, word: str) -> list[int]:
        """The labels on the one accepted path that spells ``word``, a string of symbols."""
        n, prefixes, twins, step = len(word), self.prefixes, self.twins, self.step
        states, came = [0] + [-1] * n, [(-1, -1)] * (n + 1)
        for i in range(n):
            state = states[i]
            for j in range(i + 1, n + 1):
                label = prefixes.get(word[i:j])
                if label is None:
                    break
                if label < 0 or states[j] >= 0:
                    continue
                to = step(state, label)
                if to < 0:
                    for other in twins.get(word[i:j], ()):
                        if (to := step(state, other)) >= 0:
                            label = other
                            break
                if to >= 0:
                    states[j], came[j] = to, (i, label)
        out, at = [], n
        while at > 0:
            at, label = came[at]
            out.append(label)
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; null and empty texts have none."""
        out: list[int] = []
        for step in self.steps if text else ():
            text = step(text)
        if text:
            ids, words = self.ids, self.words
            for m in self.pattern.finditer(text):
                word = m.group()
                known = words.get(word)
                if known is None:
                    known = tuple(ids[x] for x in self.labels(self.symbols(word)))
                    if len(word) <= WORD_BYTES:
                        if len(words) >= WORD_MEMORY:
                            words.clear()
                        words[word] = known
                out.extend(known)
        return out

    def decoder(self) -> dict[int, bytes]:
        """Token id -> the bytes its arc emits; the end of a word, where it is marked, is a blank."""
        return {self.ids[x]: b"".join(bytes([ord(c) % 256]) + (b" " if c > "ÿ" else b"") for c in t) for x, t in enumerate(self.spelled)}


# Fixed value: the published pattern that splits a text before byte-level merges apply.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _parts(block: dict | None, name: str) -> list[dict]:
    """The steps of a normaliser or pre-tokeniser, those of a sequence one by one."""
    if block is None:
        return []
    return [x for b in block[name] for x in _parts(b, name)] if block["type"] == "Sequence" else [block]


def _normalisation(step: dict) -> tuple[str, str, str]:
    kind = step["type"]
    if kind in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
        return (kind, "", "")
    if kind == "Replace":
        (how, pattern), *_ = step["pattern"].items()
        return (kind, pattern if how == "Regex" else regex.escape(pattern), step["content"])
    raise ValueError(f"normaliser {kind} is not supported")


def _split_pattern(steps: list[dict]) -> str:
    """The pattern whose matches are the words; the last step must be the byte alphabet."""
    *before, last = steps or [{}]
    if last.get("type") != "ByteLevel" or last.get("add_prefix_space"):
        raise ValueError("only byte-level words without a prefix blank are supported")
    if not before:
        return SPLIT_PATTERN if last.get("use_regex", True) else r"(?s).+"
    (split,) = before if len(before) == 1 else ({},)
    if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert") or "Regex" not in split["pattern"] or last.get("use_regex", True):
        raise ValueError("this way of splitting words is not supported")
    return split["pattern"]["Regex"]


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary in a tokenizer's JSON file."""
    with open(path, "rb") as f:
        raw = f.read()
    whole = json.loads(raw)
    model = whole["model"]
    if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("only plain BPE is supported")
    vocab, alphabet, end = model["vocab"], printable_bytes(), model.get("end_of_word_suffix") or ""
    label = {c: b for c, b in alphabet.items()} | ({c + end: 256 + b for c, b in alphabet.items()} if end else {})
    base = len(label)
    ids = [vocab[c] for c, _ in sorted(label.items(), key=lambda x: x[1])]
    merges = []
    for k, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((label[a], label[b]))
        label.setdefault(a + b, base + k)
        ids.append(vocab[a + b])
    steps = tuple(map(_normalisation, _parts(whole.get("normalizer"), "normalizers")))
    return Vocabulary(merges, ids, _split_pattern(_parts(whole.get("pre_tokenizer"), "pretokenizers")), base, steps, hashlib.sha256(raw).hexdigest())


_BUILT: dict[str, MergeAutomaton] = {}


def automaton(vocabulary: Vocabulary) -> MergeAutomaton:
    """The automaton of a vocabulary, compiled once in each Python process."""
    if vocabulary.key not in _BUILT:
        _BUILT[vocabulary.key] = MergeAutomaton(vocabulary)
    return _BUILT[vocabulary.key]


def emitted(ids: Iterable[int] | None, emits: dict[int, bytes]) -> str | None:
    """The text of a list of ids; broken sequences of bytes become U+FFFD."""
    return None if ids is None else b"".join(emits.get(int(x), b"") for x in ids).decode("utf-8", "replace")
