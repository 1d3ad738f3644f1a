"""Where the vocabulary files of public tokenizers are."""

from __future__ import annotations

import importlib.util
import os


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file: in SPLICEATLAS_TOKENIZERS, if set, else beside the installed public_tokenizers."""
    folder = os.environ.get("SPLICEATLAS_TOKENIZERS") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)
