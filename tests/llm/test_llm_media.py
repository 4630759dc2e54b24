"""Media whose end marks are not the first ones behind the start."""

import io
import zipfile

from sparkrec.llm import media as M


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def places(data):
    return [(x["type"], x["start"], x["length"], x["depth"]) for x in M.sniff(M.automaton(), data)]


def test_archive_in_archive():
    inner = archive({"a.txt": "text a", "b.txt": "text b"})
    outer = archive({"first.txt": "x", "inner.zip": inner, "last.txt": "y"})
    at = outer.index(inner)
    found = places(outer)
    assert found[0] == ("application/zip", 0, len(outer), 0)
    assert ("application/zip", at, len(inner), 1) in found and len(found) == 2
    assert places(b"junk" + outer + b"junk")[0] == ("application/zip", 4, len(outer), 0)
    empty = archive({})
    assert places(outer[:-4]) == [("application/zip", at, len(inner), 0)] and places(empty + b"PK\x05\x06") == places(empty)


def test_updated_pdf():
    pdf = b"%PDF-1.4\nbody\n%%EOF\nupdate\n%%EOF\nagain\n%%EOF"
    assert places(pdf + b" tail") == [("application/pdf", 0, len(pdf), 0)]
    two = pdf + b"\n" + pdf
    assert places(two) == [("application/pdf", 0, len(pdf), 0), ("application/pdf", len(pdf) + 1, len(pdf), 0)]
    assert places(b"%PDF-1.4 no end") == []
