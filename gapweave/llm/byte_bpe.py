"""Token ids of texts under a byte-level vocabulary, for the operators that write token files.

The ids are those of the tokenizers library for its vocabulary file. Where the file is a plain byte-level one whose
ranks also exist as a file for the tiktoken library, ordinary texts go to that library, which gives the same ids several
times faster. Texts that hold a string of a special token, or so long a run of white space that the other library's word
pattern could exhaust its stack, go to the tokenizers library, as do all texts of other files. Should the other library
still give up on a text, the tokenizers library takes that one too. Nothing depends on which library took a text.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The word pattern of byte-level vocabularies of this kind, as the tokenizers library has it built in (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A run of white space of such a length (known good: 500,000; known bad: 1,000,000). Only the start of a run is tried.
MOST_BLANK = 20_000
LONG_BLANK = re.compile(rf"(?<!\s)\s{{{MOST_BLANK}}}")


class Encoder:
    """special_as_text: strings of special tokens within a text are ordinary text."""

    def __init__(self, path: str, special_as_text: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size()
        pre, ranks = spec.get("pre_tokenizer") or {}, os.path.splitext(path)[0] + ".tiktoken"
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.fast = None
        if plain and os.path.exists(ranks):
            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """All ids of one text as uint32."""
        if self.fast is not None and not any(s in text for s in self.special) and (len(text) < MOST_BLANK or not LONG_BLANK.search(text)):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # a panic of the library is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, special_as_text)
