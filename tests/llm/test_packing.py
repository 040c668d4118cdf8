"""The encoder against the library, on texts of spaces and line ends."""

import struct

import pytest

from concordia.llm import packing


@pytest.mark.parametrize("text", [" ", "  ", "\n", " \n", "\n ", " a", "a ", " a b", "a\nb", "", "\t", "  "])
def test_blank_texts(text):
    encoder = packing.Encoder(**packing.default_paths())
    ids = encoder.library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
