import json

from corpusloom import cli


def test_build_and_query(spark, tmp_path, capsys):
    chunks = spark.createDataFrame([(1, "paged attention saves memory", "p"), (2, "flash-attn kernels", "p"), (3, "bananas", None)], "chunk_id long, text string, parent_id string")
    chunks.write.parquet(str(tmp_path / "chunks"))
    cli.main(["index-build", str(tmp_path / "chunks"), str(tmp_path / "index")], spark)
    cli.main(["bm25-query", str(tmp_path / "index"), "flash-attn", "--json"], spark)
    assert [json.loads(x)["chunk_id"] for x in capsys.readouterr().out.splitlines()] == [2]
    cli.main(["hybrid-query", str(tmp_path / "index"), "attention", "--json", "--top-n", "2"], spark)
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert got and got[0]["final_rank"] == 1
    cli.main(["index-info", str(tmp_path / "index"), "--json"], spark)
    assert json.loads(capsys.readouterr().out)["chunks"] == 3
    cli.main(["list"])
    assert "bm25_topn" in capsys.readouterr().out


def test_other_queries(spark, tmp_path, capsys):
    chunks = spark.createDataFrame([(1, "paged attention saves memory", "p"), (2, "flash-attn kernels", "p"), (3, "bananas", None)], "chunk_id long, text string, parent_id string")
    chunks.write.parquet(str(tmp_path / "chunks"))
    at = str(tmp_path / "index")
    cli.main(["index-build", str(tmp_path / "chunks"), at], spark)

    def said(*args):
        capsys.readouterr()
        cli.main([*args, "--json"], spark)
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    info = said("bm25-info", at)[0]
    assert (info["n_docs"], info["terms"], info["postings"]) == (3, 8, 8)
    assert [r["final_rank"] for r in said("rerank-query", at, "attention memory")][0] == 1
    assert said("agent-query", at, "how does paged attention save memory")[0]["check"] == "ok"
    spark.createDataFrame([(1, "paged attention"), (2, "bananas")], "query_id long, text string").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(1, 1), (2, 3)], "query_id long, doc_id long").write.parquet(str(tmp_path / "gold"))
    r = said("eval", at, str(tmp_path / "q"), str(tmp_path / "gold"))[0]
    assert (r["queries"], r["hit_after"]) == (2, 1.0)
