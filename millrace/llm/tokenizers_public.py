"""The public tokenizers inside tasks: loaded once in a Python worker, files by parameter and never copied."""

from __future__ import annotations

import functools
import hashlib
import re
from pathlib import Path

#: Texts of these characters only, and without the mark of a special token, give the same ids in both BPE libraries;
#: others go through the library of the .json file itself.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ſ–—‘’“”…€]*")


def path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def version(name: str) -> str:
    """Digest of a tokenizer's file: what a stored count depends on besides the text."""
    return hashlib.sha256(Path(path(name)).read_bytes()).hexdigest()


@functools.cache
def json_tokenizer(file: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(file)
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def rank_tokenizer(file: str):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(file).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(file).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def piece_tokenizer(file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=file)


def byte_bpe_ids(texts: list[str]) -> list:
    """Ids of byte_bpe_50k.json. Plain texts take the faster library, which has the same vocabulary and merges."""
    quick, exact = rank_tokenizer(path("byte_bpe_50k.tiktoken")), json_tokenizer(path("byte_bpe_50k.json"))
    return [quick.encode_ordinary(t) if PLAIN.fullmatch(t) and "<|" not in t else exact.encode(t, add_special_tokens=False).ids for t in texts]
