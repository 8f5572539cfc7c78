import math

from pyspark.sql import functions as F

from lodestore.functions import text as T
from lodestore.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokens_keep_letters_of_any_script(spark):
    assert one(spark, T.tokens(F.lit("Crème-brûlée, 2 go!"))) == ["crème", "brûlée", "2", "go"]
    assert one(spark, T.tokens(F.lit("Crème 2"), False)) == ["cr", "me", "2"]


def test_fnv1a_known_value(spark):
    assert one(spark, T.fnv1a(F.lit("w:hello"))) == 2623896756


def test_singular(spark):
    words = {"status": "status", "policies": "policy", "boxes": "box", "tokens": "token", "class": "class", "gas": "gas"}
    for w, s in words.items():
        assert one(spark, T.singular(F.lit(w))) == s


def test_redactions(spark):
    text = "mail a.b@c.org key sk-abcdefghij12 at http://x?token=abcdefghijkl and ~/secret in /Users/me/x sk-file"
    assert one(spark, T.redact(F.lit(text))) == "mail [redacted-email] key [redacted-secret] at http://x?token=[redacted-secret] and [redacted-path] in [redacted-path] sk-file"


def test_span_is_canonical(spark):
    assert tuple(one(spark, T.span_parts(F.lit("span://h-1/a%20b#L1-L2")))) == ("h-1", "a b", "L1-L2")
    for bad in ("span://h/s", "span://H/s#a", "span://h/a b#c", "span://h/s#a/b", "x"):
        assert one(spark, T.span_parts(F.lit(bad))) is None


def test_line_range(spark):
    assert tuple(one(spark, T.line_range(F.lit("L3-L9")))) == (3, 9)
    assert one(spark, T.line_range(F.lit("L9-L3"))) is None and one(spark, T.line_range(F.lit("line"))) is None


def test_entities_take_structure_before_nouns(spark):
    got = {(e.kind, e.surface) for e in one(spark, T.entities(F.lit("fix src/app.ts and userName in react policies"), ["and", "in", "fix"], ["react"]))}
    assert got == {("path", "src/app.ts"), ("id", "userName"), ("lib", "react"), ("noun", "policy")}


def test_rendered_null(spark):
    assert one(spark, T.rendered(F.lit(None).cast("string"))) is None
    assert one(spark, T.rendered(F.lit("x" * 10), 4))["clipped"]


def test_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.dot(arr(1, 2, 3), arr(4, 5))) == 14
    assert one(spark, V.normalised(arr(0, 0))) == [0, 0] and one(spark, V.is_zero(arr(0, 0)))
    assert one(spark, V.parse(F.lit("[1, 2.5]"))) == [1, 2.5]
    assert one(spark, V.parse(F.lit("[1, null]"))) is None and one(spark, V.parse(F.lit("[1]"), 2)) is None


def test_running_centroid_depends_on_order(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    a, b, c = arr(1, 0), arr(0, 1), arr(-1, 0)
    x, y = one(spark, V.running_centroid(F.array(a, b, c))), one(spark, V.running_centroid(F.array(c, b, a)))
    assert math.isclose(x[0], -y[0]) and x != y
    m = one(spark, V.merged_centroid(a, F.lit(3), b, F.lit(1)))
    assert math.isclose(m[0], 3 / math.sqrt(10))


def test_particles_and_roots(spark):
    for word, want in {"주식을": "주식", "마을": "마을", "에서": None, "학교에서는": "학교", "policies": "policy"}.items():
        assert one(spark, T.root(F.lit(word))) == want


def test_fnv1a_takes_surrogates_apart(spark):
    def plain(text):
        h = T.FNV_SEED
        units = text.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * T.FNV_PRIME) % 2**32
        return h

    for text in ("w:hello", "w:😀x", "é漢"):
        assert one(spark, T.fnv1a(F.lit(text))) == plain(text)


def test_private_endpoints_and_own_paths(spark):
    text = "at http://192.168.1.10:9301/x, tenant acme then 10.0.0.1 but 8.8.8.8 and /Users/me/code/keep/src/a.ts or /Users/me/x"
    want = "at [redacted-private-endpoint], tenant [redacted-tenant] then [redacted-private-endpoint] but 8.8.8.8 and keep/src/a.ts or [redacted-path]"
    assert one(spark, T.redact(F.lit(text), own=("keep",))) == want


def test_a_new_name_is_not_renamed_in_turn(spark):
    rows = [("supersedes: #a and RESOLVES:#b, supports : #c contradicts: a.", {"a": "b", "b": "c"}), ("no reference #a", {"a": "b"}), ("", {}), ("supports:#x", {"y": "z"}), (None, {"a": "b"})]
    t = spark.createDataFrame(rows, "t string, m map<string,string>")
    assert [r[0] for r in t.select(T.renamed_references(t.t, t.m)).collect()] == ["supersedes: #b and RESOLVES:#c, supports : #c contradicts: b.", "no reference #a", "", "supports:#x", None]


def test_slugs_of_composed_and_decomposed_letters_are_equal(spark):
    t = spark.createDataFrame([("Cafe\u0301 X",), ("Caf\u00e9 x",), (None,)], "t string")
    assert [r[0] for r in t.select(T.slug(T.composed(t.t))).collect()] == ["caf\u00e9-x", "caf\u00e9-x", None]


def test_words_are_counted_as_they_are_made(spark):
    t = spark.createDataFrame([("A b-c  1x é́ 漢字 _z!",), ("",), (" ",), (None,), ("İx K",)], "t string")
    for unicode in (True, False):
        assert all(a == b for a, b in t.select(T.count_tokens(t.t, unicode), F.when(t.t.isNotNull(), F.size(T.tokens(t.t, unicode)))).collect())


def test_a_secret_behind_a_letter_of_another_script_is_found(spark):
    t = spark.createDataFrame([("éghp_aaaaaaaaaaaaaaaaaaaaaa",), ("xghp_aaaaaaaaaaaaaaaaaaaaaa",), ("éSupports: #a",)], "t string")
    assert [r[0] for r in t.select(T.redact(t.t)).collect()][:2] == ["é[redacted-secret]", "xghp_aaaaaaaaaaaaaaaaaaaaaa"]
    assert [len(r[0]) for r in t.select(T.references(t.t)).collect()] == [0, 0, 1]
