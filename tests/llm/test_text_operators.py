import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sagefold.llm import ogg, pieces, pii, quality, queries, secrets, token_store

from . import brute
from .conftest import frame


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def both(spark, medium, odd_rows):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").limit(400).collect()
    return [(r[0], r[1]) for r in docs] + [(r[0], r[1]) for r in odd_rows]


@pytest.fixture(scope="module")
def texts(spark, medium, odd_rows):
    return both(spark, medium, odd_rows)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, [(i, t, None, None) for i, t in texts])


def test_secrets(docs, texts):
    df = secrets.scan(docs).select("doc_id", *queries._span_columns(["assign", "access", "hex"]))
    want = []
    for i, t in texts:
        spans = brute.secrets(t or "")
        want.append((i, brute.sha(brute.listed(spans)), sum(s[1] == 0 for s in spans), sum(s[1] == 1 for s in spans), sum(s[1] == 2 for s in spans)))
    assert rows_of(df, "doc_id", "base_sha256", "n_assign", "n_access", "n_hex") == sorted(want, key=str)


def test_secrets_random_tokens(spark):
    import random

    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(150)]
    dull = ["/".join(rng.choice(["usr", "share", "doc", "Local", "images", "assets", "v1"]) for _ in range(9)) for _ in range(150)]
    rows = [(k, f"see {x} there", None, None) for k, x in enumerate(keys + dull)]
    out = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(spark, rows)).collect()}
    found = sum(any(s["kind"] == "random" for s in out[k]) for k in range(150))
    false = sum(any(s["kind"] == "random" for s in out[k]) for k in range(150, 300))
    assert found > 120 and false <= 8


def test_secrets_lone_random_tokens(spark):
    """A random token alone at its length is found, whatever its p and whether there are words of other lengths."""

    def cuts_of(rows):
        return secrets.cuts(spark.createDataFrame(rows, "encoding string, n double, p double"), 0.05)

    words = [("base62", 24.0, 0.001)] * 1000
    for p in (0.02, 0.1, 0.3, 0.49, 0.51, 0.9):
        lone = [("base62", 88.0, p)]
        assert all(cuts_of(rows)["base62", 12] <= p for rows in (lone, lone + words, lone + words[:20]))
    # five among many words, none of which has a high p
    assert cuts_of(words + [("base62", 24.0, p) for p in (0.15, 0.3, 0.4, 0.6, 0.7)])["base62", 9] <= 0.15
    # words are not random, alone or many
    assert cuts_of(words)["base62", 9] > 0.001 and cuts_of(words[:1])["base62", 9] > 0.001


def test_battery_probabilities(spark):
    """p is about uniform on random tokens and near 0 on repeated ones."""
    import random

    rng = random.Random(2)
    df = spark.createDataFrame([("".join(rng.choice("0123456789abcdef") for _ in range(64)),) for _ in range(600)] + [("abcd" * 16,)], "m string")
    out = secrets.measure(df).collect()
    p = sorted(r["p"] for r in out[:-1])
    assert 0.3 < p[300] < 0.7 and out[-1]["p"] < 0.01 and {r["encoding"] for r in out} == {"hex"}


def test_personal_data(docs, texts):
    df = pii.scan(docs).select("doc_id", *queries._span_columns(["email", "ip", "card", "phone"]))
    want = []
    for i, t in texts:
        spans = brute.personal(t or "")
        want.append((i, brute.sha(brute.listed(spans)), *(sum(s[1] == k for s in spans) for k in range(4))))
    assert rows_of(df, "doc_id", "base_sha256", "n_email", "n_ip", "n_card", "n_phone") == sorted(want, key=str)


def test_disclosing_terms(spark):
    """A nickname that stands by an address in many surroundings discloses it; common words and copies do not."""
    rows = [(k, f"w{k} said zorblax f{k} bob@example.com g{k} the a{k} h{k} and", None, None) for k in range(8)]
    rows += [(100 + k, f"copy with oddword near eve@example.com the same in {'each' if k % 2 else 'each'} copy", None, None) for k in range(8)]
    rows += [(200 + k, f"plain the text number n{k} the end of it", None, None) for k in range(40)]
    rows += [(300, "Zorblax was here", None, None)]
    df = pii.scan(frame(spark, rows))
    out = {r["doc_id"]: r for r in df.withColumn("clean", pii.sanitise(F.col("_text"), F.col("spans"))).collect()}
    assert [s["kind"] for s in out[300]["spans"]] == ["term"] and "orblax" not in out[300]["clean"]
    assert "zorblax" not in out[3]["clean"] and "bob@" not in out[3]["clean"] and "<EMAIL>" in out[3]["clean"]
    assert "oddword" in out[101]["clean"] and "the" in out[3]["clean"].split()
    assert all(out[200 + k]["spans"] == [] and out[200 + k]["clean"] == out[200 + k]["_text"] for k in range(40))


def test_disclosing_terms_of_few_documents(spark):
    """A name by an address in two documents discloses it, in the same phrase too; near copies of a document are one."""
    import random

    from .conftest import words

    rng = random.Random(4)
    rows = [(k, f"{words(rng, 60)} contact Jane Quorbin at jane@example.com today {words(rng, 60)}", None, None) for k in range(2)]
    base = f"{words(rng, 60)} odd Wexlify near eve@example.com here {words(rng, 60)}".split()
    for k in range(12):
        edited = list(base)
        edited[rng.choice([*range(50), *range(80, 120)])] = f"edit{k}"
        rows.append((100 + k, " ".join(edited), None, None))
    rows += [(200 + k, f"contact today at {words(rng, 30)}", None, None) for k in range(40)] + [(300, "Quorbin and Wexlify", None, None)]
    df = pii.scan(frame(spark, rows))
    out = {r["doc_id"]: r["clean"] for r in df.select("doc_id", pii.sanitise(F.col("_text"), F.col("spans")).alias("clean")).collect()}
    assert "Quorbin" not in out[300] and "Quorbin" not in out[0] and "Wexlify" in out[300] and "Wexlify" in out[105]


def test_terms_of_a_common_passage_disclose_nothing(spark):
    """Documents that differ but share a passage around an address, with edits, have it from there."""
    import random

    from .conftest import words

    rng = random.Random(12)
    passage = f"{words(rng, 30)} rare Grumbold writes from grum@example.com every day {words(rng, 30)}".split()
    rows = []
    for k in range(9):
        edited = list(passage)
        for _ in range(3):
            edited[rng.choice([*range(28), *range(40, len(edited))])] = f"edit{rng.randrange(10**6)}"
        rows.append((k, f"{words(rng, 150)} {' '.join(edited)} {words(rng, 150)}", None, None))
    rows += [(100 + k, words(rng, 50), None, None) for k in range(40)] + [(300, "Grumbold alone", None, None)]
    out = {r["doc_id"]: r["spans"] for r in pii.scan(frame(spark, rows)).collect()}
    assert out[300] == [] and all([s["kind"] for s in out[k]] == ["email"] for k in range(9))


def test_evidence_is_whole(spark):
    """Every whole term near every entity counts, by hand; common words farther away, a text's ends and short names change nothing."""
    import random
    import re
    from collections import defaultdict

    from .conftest import words

    rng = random.Random(21)
    common, names = "that with from they have this will your about which of to in it".split(), words(rng, 2000).split()
    values = [f"user{k}@example.com" for k in range(30)]
    texts = []
    for _ in range(300):
        prose = [rng.choice(common if rng.random() < 0.25 else names) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(1, 3)):
            prose.insert(rng.randint(0, len(prose)), rng.choice(values))
        texts.append(" ".join(prose))
    texts = sorted(set(texts))
    want = defaultdict(set)
    for k, text in enumerate(texts):
        tokens = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        for m in re.finditer(r"\S+@\S+", text):
            for t, b, e in tokens:
                if m.start() - 60 <= b and e <= m.start() or m.end() <= b and e <= m.end() + 60:
                    want[m.group(), t].add(k)
    found = spark.createDataFrame(list(enumerate(texts)), "copy long, _text string").withColumn("base", pii.known(F.col("_text")))
    keys = {hashlib.sha256(f"email:{v}".encode()).hexdigest(): v for v in values}
    got = {(keys[r["c"]], r["t"]): r["n_ct"] for r in pii.evidence(found, 2).collect()}
    brief = {k for k, text in enumerate(texts) if len(text.split()) < 20}
    missing = {x: len(n) for x, n in want.items() if len(n - brief) >= 2 and got.get(x) != len(n)}
    assert missing == {} and all(len(want[x]) == n for x, n in got.items()) and len(got) > 400


def test_short_copies_with_edits_are_one_passage(spark):
    """Two short texts with most of their words in common, moved about, are no two passages."""
    pairs = ["loweind Undiciib dieenverzuie 1234 erge. lostraan bob@example.com", "loweind Und dieenverzuie sobe 1234 bob@example.com lostraan erge."]
    found = spark.createDataFrame(list(enumerate(pairs)), "copy long, _text string").withColumn("base", pii.known(F.col("_text")))
    assert pii.evidence(found, 2).collect() == []


def test_terms_beside_a_common_passage_disclose(spark):
    """A passage that documents share takes nothing from what stands by the same address elsewhere; names may open a text and be short."""
    import random

    from .conftest import words

    rng = random.Random(15)
    passage = f"{words(rng, 40)} rare Grumbold writes from grum@example.com every day {words(rng, 40)}"
    rows = [(k, f"{words(rng, 90)} {passage} {words(rng, 90)}", None, None) for k in range(6)]
    common = "that with from they have this will your about which of to in it".split()
    prose = lambda n: " ".join(w if rng.random() < 0.6 else rng.choice(common) for w in words(rng, n).split())
    rows += [(50 + k, f"Łu Tarquibble (grum@example.com) {prose(80)}", None, None) for k in range(2)]
    rows += [(100 + k, prose(40), None, None) for k in range(200)] + [(400, "Grumbold with Tarquibble and Łu", None, None)]
    out = {r["doc_id"]: r["clean"] for r in pii.scan(frame(spark, rows)).select("doc_id", pii.sanitise(F.col("_text"), F.col("spans")).alias("clean")).collect()}
    assert out[400].startswith("Grumbold with ") and "Tarquibble" not in out[400] and "Łu" not in out[400] and "Tarquibble" not in out[50]


def test_many_spans_in_one_text(spark):
    """200,000 addresses in one text: time is linear in them."""
    import time

    n = 200_000
    parts = [f"user{k}@mail{k % 7}.example.com" for k in range(n)]
    df = spark.createDataFrame([(1, " ".join(parts) + " end")], "doc_id long, text string")
    began = time.time()
    found = pii.known(F.col("text"))
    row = df.select(F.size(found).alias("n"), F.element_at(found, -1)["e"].alias("e"), pii.sanitise(F.col("text"), found).alias("clean")).first()
    assert row["n"] == n and row["e"] == len(" ".join(parts)) and row["clean"] == " ".join(["<EMAIL>"] * n) + " end"
    assert df.select(F.size(pii.contexts(F.col("text"), found))).first()[0] == n
    assert df.select(F.size(secrets.known(F.col("text")))).first()[0] == 0
    assert time.time() - began < 90


def test_sanitise_overlaps(spark):
    df = spark.createDataFrame([("1.2.3.4@mail.example.com x",)], "_text string")
    out = df.withColumn("clean", pii.sanitise(F.col("_text"), pii.known(F.col("_text")))).first()
    assert out["clean"] in ("<EMAIL> x", "<IP> x")


def test_quality_counts(docs, texts):
    df = quality.counts(docs)
    want = [(i, *brute.quality(t or "")) for i, t in texts]
    assert rows_of(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want, key=str)


def test_quality_model(spark, medium):
    """Clean documents stay; junk that no count of the base catches goes."""
    judged, _ = quality.assess(spark.read.parquet(f"{medium}/documents.parquet"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    rows = [r for r in judged.collect() if r["doc_id"] in labels and r["n_words"] >= 50 and 2 * r["n_repeat_words"] <= r["n_words"]]
    good, bad = ([r["good"] for r in rows if labels[r["doc_id"]] == k] for k in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_quality_em_recovers_rates():
    """Rules that see some of the bad documents and few good ones."""
    import numpy as np

    rng = np.random.default_rng(0)
    bad = rng.random(40_000) < 0.2
    seen, wrong = np.array([0.6, 0.5, 0.4, 0.5, 0.3]), np.array([0.01, 0.02, 0.01, 0.005, 0.02])
    votes = -(rng.random((40_000, 5)) < np.where(bad[:, None], seen, wrong)).astype(int)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, n)
    assert abs(model.prior - 0.8) < 0.05 and np.abs(model.rates[0][:, 0] - seen).max() < 0.06 and np.abs(model.rates[1][:, 0] - wrong).max() < 0.03


def test_ogg_round_trip(docs, texts):
    media = ogg.mux_documents(docs)
    back = ogg.demux_media(media, ["doc_id", "media"])
    got = rows_of(back.select("doc_id", "n_bytes", F.sha2("payload", 256).alias("sha"), "ok"), "doc_id", "n_bytes", "sha", "ok")
    want = [(i, len(b), brute.sha(b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))), True) for i, b in ((i, (t or "").encode()) for i, t in texts)]
    assert got == sorted(want, key=str)


def test_ogg_checksum_and_damage():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    assert ogg.checksum(b"OggS and more") == slow(b"OggS and more")
    media = ogg.mux(b"x" * 200_000)
    assert ogg.read_back(media)[0] and ogg.read_back(media)[2] == 200_000
    assert not ogg.read_back(media[:5000] + b"?" + media[5001:])[0]
    assert not ogg.read_back(media[:-700])[0] and not ogg.read_back(b"none")[0] and not ogg.read_back(None)[0]
    pages = ogg.paginate(7, [b"h", b"y" * 150_000, b"z"], [0, 5, 9])
    stream = ogg.demux(b"".join(pages))[7]
    assert [len(p) for p in stream.packets] == [1, 150_000, 1] and stream.granule == 9 and len(pages) == 4


@pytest.mark.parametrize("head_bytes", [0, 20_000, pieces.HEAD_BYTES])
def test_pieces(docs, texts, head_bytes):
    """With all words in the tail, with some and with as many as may be in the head."""
    import sentencepiece

    model = queries.tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    encoded = pieces.encode_documents(docs, model, head_bytes=head_bytes)
    got = rows_of(queries.pieces_digest(encoded, model), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in texts:
        ids = library.encode(t or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids) if ids else "")))
    assert got == sorted(want, key=str)


def test_pieces_of_odd_texts(spark):
    """Markers and blanks in runs, at both ends and alone; words that stand often, long ones, ties and repeated rows."""
    import random

    import sentencepiece

    model = queries.tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(4)
    parts = [" ", " ", " ", "  ", pieces.MARK, pieces.MARK * 2, "\n", "\t", "\0", "\u3000", "a", "the", "the", "Word", "internationalization", "日本", "😀", "é", "x" * 3000, "<s>", "</s>", "<unk>", "<0x0A>"]
    some = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(600)] + [(None, None), (1, "the the"), (1, "the the"), (2, " "), (3, pieces.MARK), (4, "the " * 60_000)]
    want = sorted(((i, library.encode(t or "")) for i, t in some), key=str)
    for head_bytes in (0, 600, pieces.HEAD_BYTES):
        got = pieces.encode_documents(frame(spark, [(i, t, None, None) for i, t in some]), model, head_bytes=head_bytes).collect()
        assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want


def test_token_store(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token_store.write_store(docs, str(tmp_path / "store"), path)
    got = token_store.read_digests(spark, str(tmp_path / "store")).collect()
    ids = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts), key=lambda x: (x[0] is not None, x[0]))
    assert all(r["verified"] for r in got) and len(got) == len(texts)
    assert sorted((str(r["doc"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), brute.crc_of_ids(x)) for i, x in ids)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc"] for r in ordered] == [i for i, _ in ids]
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    whole = token_store.read_documents(spark, str(tmp_path / "store")).collect()
    assert sorted((str(r["doc"]), r["ids"]) for r in whole) == sorted((str(i), x) for i, x in ids)
    keys = [bytes(r["key"]) for r in token_store.read_chunks(spark, str(tmp_path / "store")).collect()]
    assert len(keys) == len(set(keys))


def test_token_store_added_tokens():
    """Added tokens count as the plain library has them; texts around them too."""
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library, words = Tokenizer.from_file(path), token_store.WordEncoder(path, size=40)
    some = ["hello <|endoftext|> world", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "a  b   c ", "\n x\n\n  y", " \u3000 x   y", "Ωmega 日本語 тест 'S 's", "plain words only", None]
    assert encoded(words, some) == [library.encode(x or "", add_special_tokens=False).ids + [0] for x in some]
    assert 50256 in library.encode(some[0], add_special_tokens=False).ids


def encoded(words, some):
    import pyarrow as pa

    ids, stops = words.encode(*token_store.joined(pa.array(some, pa.string())), 0)
    stops = [0, *stops.tolist()]
    return [ids[a:b].tolist() for a, b in zip(stops, stops[1:], strict=False)]


def test_token_store_any_text():
    """Texts of characters that stand at the places where texts are cut, with a table that is often full."""
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library, words = Tokenizer.from_file(path), token_store.WordEncoder(path, size=300)
    rng = random.Random(6)
    pieces_ = [" ", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x85", "\xa0", "\u2003", "\u3000", "\u1680", "\0", "\x1f", "\x7f", "'", "'s", "'ll", "'S", ".", ",", "...", "!?", "(", "#", "%%%", "_", "-", "é", "ß", "日本", "😀", "\u0301", "²", "½", "٣", "7", "42", "a", "the", "Word", "internationalization", "x" * 30]
    for _ in range(30):
        some = ["".join(rng.choice(pieces_) for _ in range(rng.randrange(40))) for _ in range(100)]
        assert encoded(words, some) == [library.encode(x, add_special_tokens=False).ids + [0] for x in some]


def test_token_store_sees_damage(spark, docs, tmp_path):
    """A recipe that is lost, doubled or moved fails its part."""
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, queries.tokenizer("byte_bpe_50k.json"))
    order = spark.read.parquet(f"{path}/order")
    row = order.filter("kind = 'recipe' and row = 1").first()
    gone = order.filter(~((F.col("kind") == "recipe") & (F.col("part") == row["part"]) & (F.col("row") == 1)))
    same = (F.col("kind") == "recipe") & (F.col("part") == row["part"])
    moved = order.withColumn("row", F.when(same & (F.col("row") == 1), 0).when(same & (F.col("row") == 0), 1).otherwise(F.col("row")).cast("long"))
    for k, bad in enumerate((gone, order.unionByName(order.filter(same & (F.col("row") == 1))), moved)):
        other = str(tmp_path / f"bad{k}")
        bad.write.partitionBy("kind").parquet(f"{other}/order")
        sound = {r["part"]: r["sound"] for r in token_store.starts(spark, other)[0].collect()}
        assert [p for p, x in sound.items() if not x] == [row["part"]]


def test_crc_join():
    joiner = token_store.CrcJoiner()
    a, b = b"some bytes", b"others, more of them" * 50
    assert joiner.join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert joiner.join(5, 0, 0) == 5


def test_empty_tables(spark, empty, tmp_path):
    assert secrets.scan(empty).count() == 0 and pii.scan(empty).count() == 0
    assert quality.assess(empty)[0].count() == 0
    assert ogg.demux_media(ogg.mux_documents(empty), ["doc_id"]).count() == 0
    model = queries.tokenizer("piece_bpe_32k.model")
    assert queries.pieces_digest(pieces.encode_documents(empty, model), model).count() == 0
    token_store.write_store(empty, str(tmp_path / "s"), queries.tokenizer("byte_bpe_50k.json"))
    assert token_store.read_digests(spark, str(tmp_path / "s")).count() == 0
