import pytest

from sparkvigil.operators.policy import Policy


@pytest.mark.parametrize("policy", [Policy(), Policy(cluster="c-1", allow=["drain"], nodes=["n-*", "m-1"], jobs=["7"], dry_run=False)])
def test_round_trip(tmp_path, policy):
    path = tmp_path / "policy.yaml"
    path.write_text(policy.encode())
    assert Policy.load(str(path)) == policy and Policy.read(str(path)) == (policy, "")


def test_errors_deny_all(tmp_path):
    path = tmp_path / "policy.yaml"
    assert Policy.read(str(path)) == (Policy(), "")
    path.write_text("cluster: c-1\nallow:\n  - drain\n")
    assert Policy.load(str(path)).allow == ["drain"]  # no version: the current one
    for text in ("version: 99\nallow:\n  - drain\n", "allow:\n  - drain\nalow: x\n"):
        path.write_text(text)
        got, error = Policy.read(str(path))
        assert got == Policy() and error
        with pytest.raises(ValueError):
            Policy.load(str(path))
