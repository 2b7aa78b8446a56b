"""The ids of a word-piece vocabulary file, many documents at a time.

The library's normaliser and splitter never look across ASCII white space, nor from a Latin letter to
plain punctuation behind it. So a text's ids are those of its chunks between white space, in order,
and those of a chunk that is a Latin word with punctuation are those of the word and the punctuation.
Each worker keeps the ids of the chunks it has seen and has the library encode only new words.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Latin letters are one word to the splitter; plain punctuation may stand behind it.
LATIN, PUNCTUATION = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), ",.;:!?|%&*$#"
#: Chunks a worker keeps, characters of text encoded together, new words in one text.
MAX_CHUNKS = 600_000
TOGETHER = 3_000_000
IN_ONE = 500


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self._ends = np.zeros(self.size, bool)
        if suffix:
            self._ends[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[bytes]) -> None:
        """Add these chunks, the words in them and the punctuation behind these to what is known."""
        known = self._known
        parts: list[tuple[bytes, bytes, bytes]] = []
        words: dict[str, bytes] = {}
        rest: dict[str, bytes] = {}
        for chunk in new:
            text = chunk.decode()
            word = text.rstrip(PUNCTUATION)
            if not (word.isascii() and word.isalpha() or LATIN.fullmatch(word)):
                word = ""
            tail = text[len(word) :]
            if word and tail:
                own = word.encode()
                parts.append((chunk, own, chunk[len(own) :]))
                if own not in known:
                    words[word] = own
                if parts[-1][2] not in known:
                    rest[tail] = parts[-1][2]
            elif word:
                words[word] = chunk
            else:
                rest[tail] = chunk
        for key, ids in zip(rest.values(), self._ids(list(rest))):
            known[key] = ids.tobytes()
        # Many words as one text: each word's last token, and no other, has the suffix of a word's end.
        listed, keys = list(words), list(words.values())
        groups = range(0, len(listed), IN_ONE)
        for at, ids in zip(groups, self._ids([" ".join(listed[i : i + IN_ONE]) for i in groups])):
            own = keys[at : at + IN_ONE]
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(own):
                data, start = ids.tobytes(), 0
                for key, end in zip(own, (4 * ends).tolist()):
                    known[key] = data[start:end]
                    start = end
            else:  # a vocabulary without such a suffix
                for key, one in zip(own, self._ids(listed[at : at + IN_ONE])):
                    known[key] = one.tobytes()
        for chunk, word, tail in parts:
            known[chunk] = known[word] + known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without added special tokens."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= TOGETHER):
                chars += len(texts[stop])
                stop += 1
            # The library takes A to Z for a to z too; bytes split at the six ASCII spaces only.
            split = [t.encode().lower().split() for t in texts[at:stop]]
            seen = set().union(*split)
            # Two generations: what is used again moves to the newer one, and the older one goes when that is full.
            if len(self._known) > MAX_CHUNKS // 2:
                self._older, self._known = self._known, {}
            new = seen.difference(self._known)
            again = new.intersection(self._older)
            self._known.update((c, self._older[c]) for c in again)
            new -= again
            if new:
                self._learn(new)
            known = self._known.__getitem__
            out += [b"".join(map(known, chunks)) for chunks in split]
            at = stop
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    """One encoder for each worker process, on one thread: Spark runs many workers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)
