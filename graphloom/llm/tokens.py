"""Token ids of whole texts with a public word-level BPE tokenizer, by cached words.

The tokenizer lower-cases, drops white space and encodes each match of its split pattern alone, so
the ids of a text are those of its runs of non-blanks in order, and the ids of a run those of its
matches. Each different run is encoded once; new matches are encoded many at a time, as one text
whose ids are cut at the tokens that end a word. A run with characters beyond plain Latin, whose
matches could differ from the library's, sends its whole text to the library.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a cache generation; a full one becomes the old one, whose hits move up again.
CACHE = 150_000
#: Matches encoded as one text.
JOINED = 512
_OTHER = re.compile("[^\n\x21-\x7e\xa1-įı-ſ]")
_LETTER = "a-zªµºß-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_MATCH = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t\n\x0b\x0c\r {_LETTER}{_NUMBER}]+")


#: Stands for the ids of a run that only the library can split.
_FOREIGN = b"?"
#: Stands between the ids of runs; no id has its upper bytes set.
_MARK = b"\xff\xff\xff\xff"


class WordTokenizer:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        suffix = self.library.model.end_of_word_suffix or ""
        #: The same model, shared, for text that is normalised and split already.
        self.of_matches = Tokenizer(self.library.model)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.of_matches.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        vocabulary = self.library.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.runs: dict[bytes, bytes] = {}
        self.matches: dict[str, bytes] = {}
        self.old: tuple[dict[bytes, bytes], dict[str, bytes]] = ({}, {})

    def _learn_matches(self, new: list[str]) -> None:
        for at in range(0, len(new), JOINED):
            part = new[at : at + JOINED]
            ids = np.array(self.of_matches.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.is_end[ids]) + 1) * 4
            if len(ends) == len(part) and ends[-1] == ids.nbytes:
                data, cuts = ids.tobytes(), ends.tolist()
                words = [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                words = [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            self.matches.update(zip(part, words, strict=True))

    def _learn(self, runs: list[bytes]) -> list[bytes]:
        """The ids of runs that are not in the cache's young generation; they enter it."""
        if not runs:
            return []
        if len(self.runs) + len(runs) > CACHE:
            self.old = (self.runs, self.matches)
            self.runs, self.matches = {}, {}
        out = list(map(self.old[0].get, runs))
        todo = [i for i, ids in enumerate(out) if ids is None]
        text = b"\n".join([runs[i] for i in todo]).decode("utf-8", "replace")
        if "<|" in text or _OTHER.search(text):
            lines = text.split("\n")
            for i, line in zip(todo, lines, strict=True):
                if "<|" in line or _OTHER.search(line):
                    out[i] = _FOREIGN
            text = "\n".join([line for i, line in zip(todo, lines, strict=True) if out[i] is None])
            todo = [i for i in todo if out[i] is None]
        if todo:
            found = _MATCH.findall(text.lower())  # line feeds, as separators, too
            missing = set(found) - {"\n"}
            missing = [m for m in missing if m not in self.matches]
            known = list(map(self.old[1].get, missing))
            self.matches.update((m, ids) for m, ids in zip(missing, known, strict=True) if ids is not None)
            self._learn_matches([m for m, ids in zip(missing, known, strict=True) if ids is None])
            self.matches["\n"] = _MARK
            of_runs = b"".join(map(self.matches.__getitem__, found)).split(_MARK)
            for i, ids in zip(todo, of_runs, strict=True):
                out[i] = ids
        self.runs.update(zip(runs, out, strict=True))
        return out

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for null."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        encoded = split.flatten().dictionary_encode()
        runs = encoded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.runs.get, runs))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self._learn([runs[i] for i in missing]), strict=True):
            found[i] = ids
        taken = pa.array(found, pa.large_binary()).take(encoded.indices)
        place = split.offsets.to_numpy().astype(np.int64)
        place -= place[0]
        if len(taken) == 0:
            return [b""] * len(texts)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        data, cuts = memoryview(taken.buffers()[2] or b""), ends[place].tolist()
        out = [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        foreign = np.array([ids is _FOREIGN for ids in found])
        if foreign.any():
            at = np.flatnonzero(foreign[encoded.indices.to_numpy()])
            for i in np.unique(np.searchsorted(place, at, side="right") - 1).tolist():
                out[i] = array("I", self.library.encode(texts[i].as_py(), add_special_tokens=False).ids).tobytes()
        return out


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One a worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
