import json

from paperloom.plans import anchors as A


def test_texts_go_on_over_pages_and_columns(spark, tmp_path):
    def block(i, page, text, x, y, section="S", role="BODY"):
        return {"id": f"b{i}", "page": page, "bbox": {"x": x, "y": y, "width": 0.3, "height": 0.05}, "role": role, "readingOrder": i, "sectionPath": [section], "text": text, "confidence": 0.9, "contentMode": "TEXT"}

    pages = [
        block(0, 1, "It goes on and", 0.1, 0.85), block(1, 2, "on here.", 0.1, 0.1), block(2, 3, "New one.", 0.1, 0.1), block(3, 3, "A bro-", 0.1, 0.8), block(4, 3, "ken word", 0.6, 0.1),
        block(5, 4, "far below", 0.1, 0.5), block(6, 4, "版面", 0.1, 0.9), block(7, 5, "结构", 0.1, 0.1), block(8, 5, "not", 0.1, 0.9), block(9, 6, "- an item", 0.1, 0.1),
    ]
    spark.createDataFrame([(1, 2, 6, json.dumps(pages)), (2, 2, 1, None)], "id bigint, paper_id bigint, page_count int, blocks_json string").write.parquet(f"{tmp_path}/paper_layout_artifact.parquet")
    got = sorted((r.from_id, r.to_id, r.over, r.how) for r in A.doc_page_joins(spark, str(tmp_path)).collect())
    assert got == [("b0", "b1", "PAGE", "LOWER"), ("b3", "b4", "COLUMN", "HYPHEN"), ("b6", "b7", "PAGE", "HAN")]
    assert {r.kind for r in A.doc_anchors(spark, str(tmp_path)).collect()} == {"EXACT"}
