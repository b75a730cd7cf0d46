"""Every character against the tokenizers library; long runs of backslashes."""

import struct
import sys

from tokenizers import Tokenizer

sys.path.insert(0, "/opt/tokenizers")
import public_tokenizers  # noqa: E402

from filewarden.llm import bpe, chat  # noqa: E402


def test_every_character_encodes_as_the_library_does():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    own = bpe.transducer(path)
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert b"".join(own.encode(text)) == struct.pack(f"<{len(wanted.ids)}I", *wanted.ids), hex(ord(text[1]))


def test_a_million_backslashes():
    for text in ("\\" * 1_000_000, "\\" * 999_999 + "<s>", "a\\" * 500_000 + "[/INST]", "\\<s>\\\\<s>" * 1000):
        assert chat.parse(chat.render("user", text)) == ("user", text)
        assert chat.unescape(chat.escape(text)) == text
