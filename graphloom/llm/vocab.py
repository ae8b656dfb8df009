"""Token ids and counts of whole texts by public tokenizer files, memoised by word.

Both libraries treat a text as independent pieces: one drops white space and never merges across it, the other
never merges a character with a following space mark. So a text's ids are its pieces' ids in order, and a
worker asks the library once for each distinct piece it holds in its bounded memory.
"""

from __future__ import annotations

import json
import os
import re
import struct

#: Distinct pieces in each of a worker's two generations of memory, about 200 bytes each.
CACHE_WORDS = 400_000

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_LOADED: dict[tuple[str, str], object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory(dict):
    """Answers of ``ask`` by key, in bounded space: when a generation is full it becomes the old one, and what is
    asked for again moves to the new one. Keys of over 64 characters are not kept."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def ask(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.ask(key)
        if len(key) <= 64:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes are themselves, the others
    follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The steps before the merges that the memory by word rests on: lower case, and no token across white space, in which a run of
#: letters is one piece and a stop after a letter another.
_STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_words(file: dict) -> bool:
    """Whether a tokenizer file's steps are those that ``WordIds`` can take word by word."""
    norm, pre = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps, cuts = norm.get("normalizers", []), pre.get("pretokenizers", [])
    if ([s.get("type") for s in steps], [s.get("type") for s in cuts]) != _STEPS:
        return False
    white = steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
    apart = cuts[0].get("pattern") == {"Regex": _SPLIT} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
    plain = not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex") and file.get("post_processor") is None
    special = all(t.get("special") and not re.search(r"\s", t["content"]) and not t.get("lstrip") and not t.get("rstrip") for t in file.get("added_tokens", []))
    return white and apart and plain and special and file.get("model", {}).get("type") == "BPE"


class WordIds(Memory):
    """bytes of a word without ASCII white space -> its ids as little-endian 32-bit integers. A tokenizer file with other steps
    encodes whole texts."""

    _SIMPLE = re.compile(r"[a-zß-öø-ÿ]+")
    _OTHER = re.compile("[^\x00-\xff]")
    _STOP = re.compile(r"[.,](?=[ \n])(?<=[a-zß-öø-ÿ].)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_words(json.load(f))

    def ask(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if self._SIMPLE.fullmatch(text):  # lower-case letters are one pre-token: its merges without the steps before
            found = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]
        else:
            found = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, little-endian, 4 bytes each."""
        if not text:
            return b""
        if not self.by_word:
            found = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}I", *found)
        if not self._OTHER.search(text):  # the library folds case, and takes a stop after a letter by itself
            text = self._STOP.sub(r" \g<0>", text.lower())
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


def word_ids(path: str) -> WordIds:
    """This worker's memory for a tokenizer file."""
    key = ("ids", path)
    if key not in _LOADED:
        _LOADED[key] = WordIds(path)
    return _LOADED[key]  # type: ignore[return-value]
