"""A batch-fitted NB model scores a parquet file stream row by row; the
streamed top-3 equals the batch top-3."""

from main_data import SF_SMALL


def test_stream_scores_like_batch(spark, tmp_path):
    from lacuna.models.nb import GaussianNB
    from lacuna.operators.ranking import topk_long
    from lacuna.sources.fixtures import PLANTED_SPEC, policy_planted
    from lacuna.streaming.scoring import score_stream
    d = policy_planted(spark, SF_SMALL)
    model = GaussianNB(PLANTED_SPEC).fit(d)
    src = str(tmp_path / "src")
    d.write.parquet(src)
    stream = spark.readStream.schema(d.schema).parquet(src)
    q = (score_stream(model, stream, 3).writeStream.format("memory").queryName("scored")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT row_id, rank, class_id FROM scored").collect())
    ref = sorted(tuple(r) for r in topk_long(model.proba(d), 3).select("row_id", "rank", "class_id").collect())
    assert got == ref and len(got) == 3 * 1500
