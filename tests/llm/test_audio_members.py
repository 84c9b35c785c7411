from gneiss.llm import audio, queries

from .test_search_and_models import sound


def test_every_copy_is_named(spark, monkeypatch):
    monkeypatch.setattr(audio, "LARGE_CLASS", 3)  # the song's class goes by broadcast, the others by shuffle
    song, other = [k * k % 24 for k in range(90)], [(k * k * k + 5) % 24 for k in range(70)]
    rows = [(i, sound(song)) for i in (0, 1, 205, 391)] + [(7, sound(other)), (8, sound(other)), (9, sound([k % 7 for k in range(60)])), (60, None), (None, sound(song)), (1, sound(song))]
    df = spark.createDataFrame(rows, "rec bigint, media binary")
    got = audio.align_and_name(df, "rec", "media").collect()
    named = sorted((r["member_id"], r["match_id"], r["n_copies"]) for r in got if r["member_id"] is not None and r["match_id"] is not None)
    assert named == [(0, 0, 4), (1, 0, 4), (7, 7, 2), (8, 7, 2), (9, 9, 1), (205, 0, 4), (391, 0, 4)]
    assert [r["member_id"] for r in got if r["match_id"] is None and r["member_id"] is not None] == [60]
    assert [r for r in got if r["member_id"] is not None and r["query_id"] is not None] == []
    plain = audio.align(df, "rec", "media").collect()
    assert sorted(tuple(r)[:6] for r in got if r["member_id"] is None) == sorted(tuple(r) for r in plain)


def test_query_names_every_recording(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = queries.op7_audio(spark, "/root/testdata/sf0.001").filter("member_id IS NOT NULL").select("member_id")
    ids = table.filter("vec_id IS NOT NULL").select("vec_id").distinct()
    assert got.distinct().exceptAll(ids).isEmpty() and ids.exceptAll(got).isEmpty()
