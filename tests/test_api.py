import pytest

from chronoforest.api import METHODS, STEPS, Session, chain
from chronoforest.errors import InputError, UsageError


def test_session(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("((x_d_Bacteria_p_A:1,y_d_Bacteria_p_B:-1)n:1,(z_d_Archaea_p_C:1,w_d_Archaea_p_C:1)n:1);\n")
    (tmp_path / "s.fasta").write_text(">x_d_Bacteria_p_A\nACGT\n>y_d_Bacteria_p_Bx\nACGT\n")
    s = Session(spark)
    nodes, found = s.load_trees(str(tmp_path / "t.nwk"))
    assert {(r["check"], r["severity"]) for r in found.collect()} == {("duplicate_internal", "warning"), ("negative_branch", "error"), ("not_ultrametric", "warning")}
    for rules, severity in (({"method": "treepl"}, "info"), ({"method": "lsd2"}, "warning"), ({"method": "r8s", "require_time_tree": True}, "error")):
        _, again = s.load_trees(str(tmp_path / "t.nwk"), **rules)
        assert [r["severity"] for r in again.where("check = 'not_ultrametric'").collect()] == [severity]
    mono = {r["target"]: (r["is_monophyletic"], r["reason"]) for r in s.is_monophyletic(nodes, ["LBCA", "C", "nope"]).collect()}
    assert mono == {"LBCA": (True, None), "C": (True, None), "nope": (None, "unresolved")}
    from chronoforest.sources import alignments as AL

    cv = {r["name"]: (r["status"], r["suggestion"]) for r in s.cross_validate(nodes, AL.read_fasta(spark, str(tmp_path / "s.fasta"))).collect()}
    assert cv["x_d_Bacteria_p_A"] == ("match", None) and cv["y_d_Bacteria_p_B"] == ("only_tree", "y_d_Bacteria_p_Bx") and cv["y_d_Bacteria_p_Bx"] == ("only_alignment", None)
    with pytest.raises(InputError):
        s.cross_validate(nodes, AL.read_fasta(spark, str(tmp_path / "s.fasta")), strict=True)
    assert chain(["drop_negative_lengths", "drop_internal_labels"], nodes).where("branch_length < 0 OR label = 'n'").count() == 0
    (tmp_path / "e.nwk").write_text("(((\n")
    with pytest.raises(InputError):
        s.load_trees(str(tmp_path / "e.nwk"))
    s.register_sql()
    got = spark.sql("SELECT t.label, t.leaf_lo FROM VALUES ('(A:1,(B:2,C:3):1);') AS x(text), LATERAL newick_nodes(x.text) AS t WHERE t.is_leaf ORDER BY 2").collect()
    assert [r["label"] for r in got] == ["A", "B", "C"]


def test_registry():
    METHODS.register("Mine", lambda: 1)
    assert METHODS.get("MINE")() == 1 and "drop_internal_labels" in STEPS.names()
    with pytest.raises(UsageError):
        METHODS.get("other")
