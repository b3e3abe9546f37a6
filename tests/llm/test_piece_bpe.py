"""Piece encoding against the library, and a round trip over the awkward texts."""

import hashlib
import random

import pytest

from fieldbook.llm import piece_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "    ", "eins zwei", "eins  zwei ▁ drei▁▁", "a" * 5000, " " * 700, "a\0b\tc\r\nd", "x퟿ \U0001f600 emoji " * 30, "</s><s><unk><0x41>", "日本語" * 50, "ÉCOLE straße İstanbul ΣΑΣ", "\n\n\t  x",
    "ab" * 3000, "the same text", "the same text", "one two three, four.\nfive!" * 400, " private ", "word" + "x" * 70 + " y", "ﬁ ligature ﷺ",
]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)


def test_texts_as_the_library_encodes_them(spark, library):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int, decoded string").repartition(3)
    got = {r.doc_id: r for r in piece_bpe.encode(docs, piece_bpe.load_model(PATH), decoded=True).collect()}
    for i, t in enumerate(TEXTS):
        want = library.encode(t or "", add_eos=True)
        assert (got[i].ids, got[i].decoded) == (want, library.decode(want))
    again = piece_bpe.decode(piece_bpe.encode(docs, piece_bpe.load_model(PATH)), piece_bpe.load_model(PATH)).collect()
    assert {r.doc_id: r.decoded for r in again} == {i: r.decoded for i, r in got.items()}
    rows = {r.doc_id: r for r in piece_bpe.digests(spark, docs, PATH).collect()}
    assert rows[0].n_tokens == 1 and rows[0].ids_sha256 == hashlib.sha256(b"2").hexdigest() and rows[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert piece_bpe.digests(spark, docs.where("false"), PATH).count() == 0


def test_made_up_texts_as_the_library_encodes_them(library):
    r, model = random.Random(1), piece_bpe.load_model(PATH)
    texts = ["".join(r.choice(model.pieces[300:]) for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += ["".join(r.choice("etahni ▁") for _ in range(r.randint(1, 60))) for _ in range(1500)] + ["".join(r.choice(" ab\n") for _ in range(r.randint(1, 90))) for _ in range(800)]
    encoder, decoder = piece_bpe.Encoder(model, "made up"), piece_bpe.Decoder(model)
    lists = encoder.encode(texts)
    assert lists.to_pylist() == library.encode(texts, add_eos=True)
    assert decoder.decode(lists) == [library.decode(x) for x in lists.to_pylist()]


def brute(text, model, order):
    parts = list(text)
    while True:
        found = [(order[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in order]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_backtracking_on_small_vocabularies():
    """Made-up vocabularies, with pieces that never come about, equal scores, pieces across spaces and characters that are no pieces."""
    r = random.Random(2)
    for k in range(60):
        letters = "abc▁"[: r.randint(2, 4)]
        singles = [c for c in letters if k % 3 or c != "b"]
        longer = list({"".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 25))})
        pieces = ["<unk>", "</s>", *longer, *singles]
        scores = [0.0, 0.0, *[-float(r.randint(1, 8)) for _ in longer], *[-99.0 for _ in singles]]
        model = piece_bpe.Model(pieces, scores, [2, 3] + [1] * (len(pieces) - 2), 1, True)
        order, made = {p: -s for p, s in zip(pieces[2:], scores[2:], strict=True)}, piece_bpe.Pieces(model)
        for _ in range(40):
            text = "▁" + "".join(r.choice(letters) for _ in range(r.randint(1, 80)))
            ids = made.encode_words(made.cut.findall(text))[0].tolist()
            assert ids == [pieces.index(p) if p in pieces else 0 for p in brute(text, model, order)]


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"\x0a\x05\x0a\x03abc\x12\x02\x18\x01\x1a\x02\x18\x01")
    with pytest.raises(ValueError, match="merge-type"):
        piece_bpe.load_model(str(path))
