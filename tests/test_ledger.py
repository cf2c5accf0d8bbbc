import os
import time

from quern.sources import files, ledger


def put(folder, **texts):
    for name, text in texts.items():
        path = folder / (name.replace("__", "/") + ".md")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def texts(kept):
    return {os.path.basename(r.path): r.text for r in kept.documents().collect()}


def test_stopped_ingest_goes_on(spark, tmp_path):
    folder = tmp_path / "docs"
    put(folder, **{f"f{i}": f"text {i}" for i in range(12)}, sub__deep="deep")
    (folder / "bad.docx").write_bytes(b"no zip")
    (folder / "x.bin").write_bytes(b"other")
    kept = ledger.FolderIngest(spark, f"file://{tmp_path}/kept")
    seen = []
    first = kept.run(f"file://{folder}", batch_files=4, progress=lambda done, total: seen.append((done, total)) or len(seen) < 2)
    assert 0 < first < 14 and seen[-1] == (first, 14)
    again = ledger.FolderIngest(spark, f"file://{tmp_path}/kept")
    assert again.run(f"file://{folder}", batch_files=4) == 14 - first
    assert texts(again) == {f"f{i}.md": f"text {i}" for i in range(12)} | {"deep.md": "deep"}
    assert [(os.path.basename(r.path), r.state) for r in again.ledger().where("state <> 'read'").collect()] == [("bad.docx", "failed")]
    assert again.run(f"file://{folder}") == 0 and again.run(f"file://{folder}", retry=True) == 1
    time.sleep(1.1)
    put(folder, f3="new text", f20="added")
    os.remove(folder / "f5.md")
    assert again.run(f"file://{folder}") == 2
    want = {f"f{i}.md": f"text {i}" for i in range(12) if i not in (3, 5)} | {"deep.md": "deep", "f3.md": "new text", "f20.md": "added"}
    assert texts(again) == want
    put(folder, f5="back")
    assert again.run(f"file://{folder}") == 1 and texts(again) == want | {"f5.md": "back"}


def test_preview_by_depth_and_sample(spark, tmp_path):
    put(tmp_path, a="1", b__c="22", b__c__d="333", b__e="4444")
    listed = files.list_files(spark, f"file://{tmp_path}")
    name = lambda **more: [r.name for r in ledger.preview_files(listed, f"file://{tmp_path}", **more).collect()]
    assert name() == ["a.md", "c.md", "d.md", "e.md"] or sorted(name()) == ["a.md", "c.md", "d.md", "e.md"]
    assert sorted(name(depth=2)) == ["a.md", "c.md", "e.md"] and name(depth=1) == ["a.md"] and len(name(sample=2)) == 2
