"""Token ids of whole texts, with a bounded cache of words.

Every step of the tokenizer keeps white space apart, so the ids of a text are the ids of its words in a row. Long-tailed texts
repeat most words; only new words go through the tokenizer's own normaliser, splitter and BPE model. Words of Latin letters and
ASCII signs skip the first two, which amount to lower-casing and one pattern there.

The tokenizer's added tokens (``<|endoftext|>``) are cut out of a text before its words and give their own ids, as in
``Tokenizer.encode(text, add_special_tokens=False)``. With ``spell_special`` special tokens are spelt out like other text instead, as with
``encode_special_tokens``.
"""

from __future__ import annotations

import re
import sys
import types

#: words kept per Python worker; the cache starts anew beyond that
MAX_WORDS = 400_000

# Fixed value: how the tokenizer splits a word of Latin letters, digits and ASCII signs.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+"
# Fixed value: letters without a decomposed form in use, and printable ASCII.
PLAIN = r"[ -~À-ÖØ-öø-ſ]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None, spell_special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.tokenizer.encode_special_tokens = spell_special
        added = {i: t for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (spell_special and t.special)}
        #: tokens that are not simply found as written need the whole text
        self.whole = any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.added = {t.content.encode(): self.packed[i] for i, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")").split if added else None
        self.words: dict[bytes, bytes] = dict(self.added)
        self.seen: dict[str, bytes] = {}  # the parts of words: their letters without case and signs
        self.plain, self.pieces = re.compile(PLAIN).fullmatch, re.compile(PIECES).findall
        # byte-level models spell each byte as one character; printable ASCII and Latin-1 signs stand for themselves
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.spelt = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.spelt)
        packed = self.packed
        out = self.seen[piece] = b"".join([packed[t.id] for t in self.model.tokenize(spelt)])
        return out

    def _learn(self, words: list[bytes]) -> None:
        known, seen = self.words, self.seen
        text = b" ".join(words).decode()
        if not self.plain(text):
            if len(words) > 1:
                for w in words:
                    self._learn([w])
                return
            normal = self.tokenizer.normalizer.normalize_str(text)
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
            known[words[0]] = b"".join([self.packed[t.id] for p, _ in pieces for t in self.model.tokenize(p)])
            return
        for word, low in zip(words, text.lower().split(" ")):
            pieces = (low,) if low.isalpha() else self.pieces(low)
            known[word] = b"".join([seen[p] if p in seen else self._piece(p) for p in pieces])

    def ids(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace")
        if self.whole:
            return b"".join([self.packed[i] for i in self.tokenizer.encode(data.decode(), add_special_tokens=False).ids])
        words = data.split()
        if any(a in data for a in self.added):
            words = [w for i, part in enumerate(self.cut(data)) for w in ([part] if i % 2 else part.split())]
        known = self.words
        new = set(words).difference(known)
        if new:
            if len(known) > MAX_WORDS:
                known.clear()
                known.update(self.added)
                new = set(words).difference(known)
            if len(self.seen) > MAX_WORDS:
                self.seen.clear()
            self._learn(list(new))
        return b"".join(map(known.__getitem__, words))


def word_ids(path: str | None = None, spell_special: bool = False) -> WordIds:
    """The worker process's own instance: tasks that follow one another share its cache."""
    here = sys.modules.setdefault("_tablesmith_worker", types.ModuleType("_tablesmith_worker"))
    kept = here.__dict__.setdefault("word_ids", {})
    if (path, spell_special) not in kept:
        kept[path, spell_special] = WordIds(path, spell_special)
    return kept[path, spell_special]
