import pytest
from pyspark.sql import functions as F

from lattica.functions import identity, scalars, vocab


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("kind", "key", "ref", "error"),
    [
        ("currency", " EUR ", "currency:EUR", None),
        ("member", "HIP24436", "member:HIP24436", None),
        ("member", "member-giant-42", None, "positional-member"),
        ("currency", "  ", None, "empty-key"),
        ("currency", "a:b", None, "colon-in-key"),
        ("code", "a:b", "code:a:b", None),
        ("planet", "x", None, "unknown-kind"),
        ("currency", None, None, "empty-key"),
    ],
)
def test_refs(spark, kind, key, ref, error):
    assert one(spark, identity.make_ref(F.lit(kind), F.lit(key).cast("string"))) == ref
    assert one(spark, identity.ref_error(F.lit(kind), F.lit(key).cast("string"))) == error


def test_strict_refs_raise(spark):
    with pytest.raises(Exception, match="unknown-kind"):
        one(spark, identity.make_ref(F.lit("planet"), F.lit("x"), strict=True))


def test_parsed_refs(spark):
    assert one(spark, identity.ref_kind(F.lit("code:a:b"))) == "code"
    assert one(spark, identity.ref_key(F.lit("code:a:b"))) == "a:b"
    for bad in ("code:", ":x", "planet:x", "", None):
        assert one(spark, identity.is_ref(F.lit(bad).cast("string"))) is False


def test_other_ids(spark):
    assert one(spark, identity.corridor_ref(F.lit("usd"), F.lit("eur"), rail=F.lit("SWIFT"), family=F.lit("FX"))) == "corridor:USD→EUR·fx·swift"
    assert one(spark, identity.corridor_ref(F.lit("usd"), F.lit("eur"))) == "corridor:USD→EUR"
    assert one(spark, identity.community_ref(F.lit("7"), F.lit("42"))) == "community:v7-42"
    assert one(spark, identity.community_ref(F.lit(" "), F.lit("42"))) is None
    assert one(spark, identity.edge_id(F.lit(" Q "), F.lit("a"), F.lit("b"), F.lit(" 1 "))) == "edge:Q:a→b:1"
    assert one(spark, identity.edge_id(F.lit(" "), F.lit("a"), F.lit("b"))) is None
    assert one(spark, identity.edge_id(F.lit(""), F.lit("a"), F.lit("b"), blank_kind=True)) == "edge::a→b"


def test_hash(spark):
    assert one(spark, identity.fnv1a(F.lit("community:v7-42"))) == 443927360
    assert one(spark, identity.fnv1a(F.lit(""))) == 2166136261
    assert one(spark, identity.community_color(F.lit("community:v7-42"))) == vocab.REF_PALETTE[0]
    assert -1 <= one(spark, identity.seed_scalar(F.lit("x"), 3)) < 1


@pytest.mark.parametrize(("value", "size"), [(None, 6), (0.0, 6), (-4.0, 6), (float("nan"), 6), (float("inf"), 6), (16.0, 8), (1e9, 48)])
def test_sizes(spark, value, size):
    assert one(spark, scalars.size_of(F.lit(value).cast("double"))) == size


def test_costs(spark):
    cost = lambda w, r: one(spark, scalars.edge_cost(F.lit(w).cast("double"), F.lit(r).cast("double")))
    assert cost(2.0, 0.5) == 2.0
    assert cost(float("inf"), 1.0) == 0.0
    assert cost(None, float("inf")) == float("-inf")
    assert cost(None, 0.0) is None and cost(None, -1.0) is None and cost(None, None) is None


def test_segment_distances(spark):
    d2 = lambda *x: one(spark, scalars.segment_distance2(*(F.lit(float(v)) for v in x)))
    assert d2(50, 5, 0, 0, 100, 0) == 25
    assert d2(150, 0, 0, 0, 100, 0) == 2500
    assert d2(3, 4, 0, 0, 0, 0) == 25


def test_camera(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert one(spark, scalars.screen_to_world(scalars.world_to_screen(*lit(7, 3, 100, 2)), *lit(3, 100, 2))) == 7
    assert one(spark, scalars.zoom_around(*lit(1, 100))) == 8
    before, after, pan = 2.0, 4.0, 3.0
    moved = one(spark, scalars.pan_after_zoom(*lit(80, pan, 100, before, after)))
    assert one(spark, scalars.screen_to_world(*lit(80, moved, 100, after))) == one(spark, scalars.screen_to_world(*lit(80, pan, 100, before)))
    assert one(spark, scalars.normalized_size(*lit(48, 2))) == 12
    assert one(spark, scalars.eased(*lit(0, 10, 320))) == 10


def test_colors(spark):
    theme = F.create_map(F.lit("--a"), F.lit("#111"))
    assert one(spark, scalars.resolved_color(F.lit("var(--a, #222)"), theme)) == "#111"
    assert one(spark, scalars.resolved_color(F.lit("var(--b, #222)"), theme)) == "#222"
    assert one(spark, scalars.resolved_color(F.lit("var(--b)"), theme)) is None
    assert one(spark, scalars.resolved_color(F.lit("red"), theme)) == "red"
    assert [one(spark, scalars.community_slot(F.lit(x))) for x in (8, 11, -1)] == [vocab.NUMBER_PALETTE[i] for i in (0, 3, 7)]


def test_lenses():
    assert len(vocab.LENSES) == 14 and {x.label_budget for x in vocab.LENSES.values()} <= {80, 120, 200}
    assert all(vocab.check_lens(x) for x in vocab.LENSES.values())
    assert vocab.lens("nothing") is None and not vocab.is_known_lens("nothing")
    with pytest.raises(vocab.LensError):
        vocab.check_lens(vocab.lens("raw"), -1)
