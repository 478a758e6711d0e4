import hashlib
import random

import public_tokenizers
import sentencepiece

from tests.llm.data import documents, frame
from uqframe.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", " ", "  ", "\n", "▁", "é", "日本", "😀", "23", ".", ",", "\t", "\x00", "<s>",
         "<0x41>", "ing", "́", "ß", "((", "\r\n", "x" * 20, "http://", "__init__", "'s", "”."]


def test_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    tool = pieces.Encoder(pieces.Vocabulary.load(MODEL))
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 25)))
        ids = library.encode(text)
        assert tool.encode(text) == ids and tool.decode(ids) == library.decode(ids)


def test_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for row in documents():
        ids = library.encode(row[1] or "")
        want.append((row[0], len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in pieces.encode_documents(frame(spark), MODEL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.encode_documents(frame(spark, []), MODEL).count() == 0
