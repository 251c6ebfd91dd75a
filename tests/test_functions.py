"""Scalar functions and codecs on small values, with the corner cases pinned."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import chunks, hashes, keys, paths, priority, ranges, specs


def test_lookup3_known_values():
    c, b = hashes.lookup3([b"", b"Four score and seven years ago"])
    assert [hex(x) for x in c] == ["0xdeadbeef", "0x17770551"]
    assert hex(b[1]) == "0xce7226e6"
    c, b = hashes.lookup3([b"Four score and seven years ago"], 1)
    assert (hex(c[0]), hex(b[0])) == ("0xcd628161", "0x6cbea4b3")


def test_ciphers():
    assert hashes.arc4(b"Plaintext", b"Key").hex() == "bbf316e8d940af0ad3"
    data, key = bytes(range(200)), bytes(range(16))
    for iv in (b"abcd", b"abcdefgh"):
        assert hashes.salsa20(hashes.salsa20(data, key, iv, 3), key, iv, 3) == data
        assert hashes.salsa20(data, key, iv, 3) != hashes.salsa20(data, key, iv, 4)
    with pytest.raises(ValueError):
        hashes.salsa20(data, key, b"abc")


@given(st.binary(max_size=3000), st.sampled_from(["stored", "zlib", "lz4"]), st.integers(1, 700))
@settings(max_examples=40, deadline=None)
def test_container_round_trip(data, mode, size):
    assert chunks.read_container(chunks.build_container(data, size, mode)) == data


def test_container_encrypted_and_damaged():
    key, data = bytes(16), b"x" * 1000
    blob = chunks.build_container(data, 300, "zlib", lambda p, i: chunks.encrypt_chunk(p, 7, key, b"abcd", i))
    assert chunks.read_container(blob, {7: key}) == data
    with pytest.raises(chunks.FormatError):
        chunks.read_container(blob)
    bad = bytearray(chunks.build_container(data, 300, "stored"))
    bad[-1] ^= 1
    with pytest.raises(chunks.FormatError):
        chunks.read_container(bytes(bad))
    with pytest.raises(chunks.FormatError):
        chunks.read_container(b"nonsense")
    lone = chunks.build_container(data, 2000, "zlib", lambda p, i: chunks.encrypt_chunk(p, 7, key, b"abcd", i), single=True)
    with pytest.raises(chunks.FormatError):
        chunks.read_container(lone, {7: key})


@given(st.binary(max_size=600), st.binary(max_size=600))
@settings(max_examples=40, deadline=None)
def test_delta_round_trip(old, new):
    for make in (chunks.delta_simple, chunks.delta_chunked, chunks.delta_suffix):
        assert chunks.apply_delta(old, make(old, new)) == new


def test_delta_finds_matches():
    old = hashlib.sha256(b"a").digest() * 8 + bytes(range(256))
    new = old[40:] + b"tail" + old[:100]
    assert chunks.delta_stats(chunks.delta_suffix(old, new))["match_percent"] > 95


@pytest.mark.parametrize(
    ("spec", "ok"),
    [("n", True), ("z", True), ("z:9", True), ("z:{9,mpq,15}", True), ("z:{,zlib}", True), ("z:0", False), ("z:{9,15}", True), ("z:{9,7}", False), ("e:{0123456789abcdef,aabb,z}", True), ("e:{0123,aabb,z}", False), ("b:{1K*2=z,*=n}", True), ("b:{*=z,*=n}", False), ("b:1M=z", True), ("b:z", True), ("b:{1G=z}", False), ("c:{7}", True), ("c:{8}", False), ("g:{12}", True), ("q", False), ("", False), ("nn", False)],
)
def test_spec_grammar(spec, ok):
    assert specs.valid(spec) is ok


def test_spec_nodes():
    nodes = specs.parse("b:{1K*2=z:9,*=e:{0123456789abcdef,aabb,n}}")
    assert [(n["path"], n["kind"], n["size"], n["count"]) for n in nodes] == [("0", "BlockTable", None, None), ("0.0", "ZLib", 1024, 2), ("0.1", "Encrypted", None, None), ("0.1.0", "None", None, None)]


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_paths(spark):
    got = one(spark, "p string", [("a\\b/c.tar.gz",), ("noext",), ("dir/trail.",), ("",), (None,)], paths.file_name(F.col("p")), paths.directory(F.col("p")), paths.extension(F.col("p")))
    assert got == [("c.tar.gz", "a\\b", "gz"), ("noext", None, None), ("trail.", "dir", ""), ("", None, None), (None, None, None)]


def test_patterns(spark):
    p = F.col("p")
    got = one(spark, "p string", [("AbC",), ("a*c",)], paths.matches_pattern(p, "ab*bc"), paths.matches_pattern(p, "*B*"), paths.matches_pattern(p, "a*c*x"))
    assert got == [(True, True, False), (False, False, False)]


def test_typed_values(spark):
    r = F.col("r")
    got = one(spark, "r string", [("",), ("12",), (" 12",), ("+7",), ("ABC",), ("ab0C",), (None,)], keys.typed_value(r, "DEC"), keys.typed_value(r, "HEX"), keys.typed_value(r, "STRING"))
    assert [g[0] for g in got] == [None, 12, None, 7, None, None, None]
    assert [None if g[1] is None else bytes(g[1]).hex() for g in got] == [None, "12", None, None, None, "ab0c", None]
    assert got[0][2] is None
    with pytest.raises(Exception, match="not a DEC value"):
        one(spark, "r string", [("x1",)], keys.typed_value_strict(r, "DEC"))


def test_buckets(spark):
    k = F.col("k")
    rows = [(bytes(range(16)),), (b"\xff" * 16,), (b"ab",), (None,)]
    got = one(spark, "k binary", rows, keys.bucket(k), keys.bucket_seeded(k, 1), keys.residency_bucket(k))

    def fold(b, n):
        x = 0
        for v in b[:n]:
            x ^= v
        return x

    for (b,), g in zip(rows[:2], got, strict=False):
        x = fold(b, 9)
        assert g[0] == (x & 15) ^ (x >> 4)
        assert g[1] == (((x >> 4) ^ x) + 1) & 15
        y = fold(b, 16)
        assert g[2] == ((y >> 4) ^ y) & 15
    assert got[2][0] == 0
    assert got[3][0] is None


def test_priorities(spark):
    got = one(spark, "p int", [(-128,), (127,), (0,), (3,)], priority.effective(F.col("p"), 5, 3), priority.effective(F.col("p"), 5, 2), priority.category(F.col("p")))
    assert got == [(-128, -128, "Critical"), (122, 127, "Low"), (-5, 0, "Essential"), (-2, 3, "Normal")]


def test_sizes_and_offsets(spark):
    got = one(spark, "s long", [(0,), (1023,), (1024,), (1536,), (1 << 50,), (None,)], priority.human_size(F.col("s")))
    assert [g[0] for g in got] == ["0 B", "1023 B", "1 KB", "1.5 KB", "1024 TB", None]
    got = one(spark, "b binary", [(b"\x00\x00\x00\x01\x00",)], keys.uint_be(F.col("b")), keys.uint_le(F.col("b")))
    assert got == [(256, 1 << 24)]
    got = one(spark, "a int, o long", [(513, 7)], priority.unpack_offset(priority.pack_offset(F.col("a"), F.col("o"))))
    assert tuple(got[0][0]) == (513, 7)


def test_ranges(spark):
    got = one(spark, "h string", [("bytes 5-9/100",), ("bytes 5-8/*",), ("junk",)], ranges.content_range_ok(F.col("h"), F.lit(5), F.lit(5)))
    assert [g[0] for g in got] == [True, False, False]


def test_byte_search(spark):
    got = one(spark, "b binary", [(b"aaaa",), (b"",), (None,)], keys.find_all_bytes(F.col("b"), b"aa"), keys.find_bytes(F.col("b"), b"aa"))
    assert got[0] == ([0, 1, 2], 0)
    assert got[1] == ([], None)


def test_hash_columns(spark):
    got = one(spark, "p string", [("a/b",), ("A\\B",), (None,)], hashes.path_hash(F.col("p")), hashes.hash32(F.col("p")))
    assert got[0][0] == got[1][0] is not None
    assert got[2] == (None, None)
    assert one(spark, "x long", [(1,)], hashes.murmur_final(F.col("x")))[0][0] == 0xB456BCFC34C2CB2C - (1 << 64)


def test_delta_by_suffixes_is_small_and_fast():
    import random
    import time

    from strandline.functions.chunks import apply_delta, delta_suffix
    from strandline.functions.suffixes import longest_matches

    r = random.Random(4)
    old = bytes(r.choice(b"abcd") for _ in range(400))
    new = old[200:300] + b"zz" + old[:150]
    size, place = longest_matches(old, new)
    assert (size[0], place[0]) == (100, 200) and (size[102], place[102]) == (150, 0)
    assert apply_delta(old, delta_suffix(old, new)) == new
    old = b"A" * 100_000 + bytes(r.getrandbits(8) for _ in range(100_000))
    new = old[50_000:] + b"new" + old[:60_000]
    began = time.time()
    patch = delta_suffix(old, new)
    assert apply_delta(old, patch) == new
    assert len(patch) < 2000 and time.time() - began < 20


def test_deltas_of_many_short_pairs_at_once():
    import random
    import time

    from strandline.functions.chunks import apply_delta, delta_suffix, delta_suffix_many

    r = random.Random(5)
    word = lambda n: bytes(r.choice(b"ab\0\xff") for _ in range(n))
    pairs = [(a * 3, a + word(r.randrange(9)) + a * 2) for a in (word(r.randrange(40)) for _ in range(300))] + [None, (b"", b""), (b"", b"x" * 40), (b"x" * 40, b"")]
    assert delta_suffix_many(pairs) == [p and delta_suffix(*p) for p in pairs] and delta_suffix_many([]) == [] and delta_suffix_many([None]) == [None]
    assert all(p is None or apply_delta(p[0], d) == p[1] for p, d in zip(pairs, delta_suffix_many(pairs), strict=True))
    pairs = [(b"hot bolt" * 6, b"hot bolt" * 5 + b"%d" % i + b"hot bolt" * 3) for i in range(4000)]
    began = time.time()
    delta_suffix_many(pairs)
    many = time.time() - began
    began = time.time()
    for p in pairs[:400]:
        delta_suffix(*p)
    assert many < 6 * (time.time() - began)  # ten times as many


def test_unpack_by_spec():
    import zlib

    from strandline.functions.specs import SpecError, unpack_by_spec

    z = zlib.compress(b"tail")
    assert unpack_by_spec(b"abc", "n") == b"abc"
    assert unpack_by_spec(z, "z") == b"tail"
    assert unpack_by_spec(b"head" + z, "b:{4=n,*=z}") == b"headtail"
    assert unpack_by_spec(b"aabb" + z, "b:{2*2=n,*=z}") == b"aabbtail"
    assert unpack_by_spec(b"ab", "b:{9=n,*=z}") == b"ab"
    with pytest.raises(SpecError):
        unpack_by_spec(b"abc", "c")
