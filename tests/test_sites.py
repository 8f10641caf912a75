"""Saved sites (S5, S6, JN12, K3): folders of any shape, read in one scan."""

import json
import os

from linkloom.operators import rollup
from linkloom.sources import inputs


def test_folders_of_sites(spark, tmp_path):
    """Nodes may be missing, empty or broken, a summary may lack fields, and a folder without one does not count."""
    good = {"url": "http://a/1", "same_site": True, "queueable": True, "first_depth": 0, "first_source": "s", "first_method": "seed", "seen_count": 1, "page_kind": "page"}
    for name, summary, nodes in (
        ("a_b", {"site_host": "a", "completed": True, "counts": {"edges": 3, "visit_ok": 2}, "other": [1]}, [json.dumps(good), "", json.dumps(good), '{"url": "cut', "  "]),
        ("no_nodes", {"site_host": "x.cbpt.cnki.net", "counts": {}}, None),
        ("none", {}, []),
        ("only_nodes", None, [json.dumps(good)]),
    ):
        os.makedirs(tmp_path / name)
        if summary is not None:
            (tmp_path / name / "summary.json").write_text(json.dumps(summary, indent=2), encoding="utf-8")
        if nodes is not None:
            (tmp_path / name / "nodes.jsonl").write_text("".join(line + "\n" for line in nodes), encoding="utf-8")
    rows = rollup.saved_report(inputs.saved_summaries(spark, str(tmp_path)), inputs.saved_nodes(spark, str(tmp_path))).collect()
    got = {r["site_folder"]: (r["site_family"], r["completed"], r["edges"], r["visit_ok"], r["links"], r["urls"], r["broken_lines"]) for r in rows}
    assert got == {"a_b": ("generic", True, 3, 2, 2, 1, 1), "no_nodes": ("cbpt_cnki", False, 0, 0, 0, 0, 0), "none": ("", False, 0, 0, 0, 0, 0)}
