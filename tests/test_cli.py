"""The command line's verbs."""

from __future__ import annotations

from cairnstore.__main__ import run


def test_verbs(spark, tmp_path, capsys):
    root, key = str(tmp_path / "s"), str(tmp_path / "key")
    body = tmp_path / "body.bin"
    body.write_bytes(bytes(range(256)) * 40)
    (tmp_path / "empty").write_bytes(b"")
    do = lambda *a: run(spark, [root, "--keyfile", key, *a])
    assert do("init", "--volume", "v0") == 1 and do("init", "--volume", "v0=a", "--chunk-size", "12") == 1
    assert do("init", "--volume", "v0=a", "--volume", "v1=b", "--chunk-size", "4k") == 0
    assert do("init", "--volume", "v0=a") == 1 and "already" in capsys.readouterr().err
    assert do("tip") == 0 and do("ls") == 0
    assert capsys.readouterr().out == "(empty log)\nstore is empty\n"
    assert do("put", str(body), str(tmp_path / "empty")) == 0 and do("put", str(body)) == 0
    out = capsys.readouterr().out
    assert "new" in out and out.endswith("no changes\n")
    assert do("get", "body.bin", "--output", str(tmp_path / "out")) == 0 and (tmp_path / "out").read_bytes() == body.read_bytes()
    assert do("ls") == 0 and "empty\t0\t0" in capsys.readouterr().out
    assert do("rm", "nothing") == 1 and do("rm", "empty") == 0 and do("get", "empty", "--at", "0", "--output", str(tmp_path / "e")) == 0
    assert do("stats") == 0 and do("compact") == 0 and do("mirror", str(tmp_path / "m"), "--volume", f"v0={tmp_path / 'm'}") == 1
    assert "v0\t" in capsys.readouterr().out
    assert run(spark, [root, "ls"]) == 1
