"""Small input files, our own, in the layouts that the tests need."""

import gzip
import json


def boats():
    """A list, an object and a decimal in each record."""
    return [{"no": i, "crew": [f"{c}-{k}" for k in ("skipper", "mate", "cook")], "port": {"town": c.upper()}, "length": i + 0.25} for i, c in enumerate(("oslo", "pisa", "riga", "siem", "turk"), 1)]


def grids():
    """Lists of lists and objects of objects."""
    return [{"no": i, "grid": [[i * 10, i * 10 + 1], [i * 10 + 2, i * 10 + 3]], "box": {"lid": {"tag": f"t{i}"}}} for i in range(1, 6)]


def visits():
    """Six visits of three guests; those of guest 20 are out of order."""
    rows = [(10, "2031-05-01T08", "in"), (10, "2031-05-01T12", "lunch"), (10, "2031-05-01T17", "out"), (20, "2031-05-04T09", "out"), (20, "2031-05-02T09", "in"), (30, "2031-05-03T10", "in")]
    return [{"guest": g, "at": t, "what": w} for g, t, w in rows]


def lines(rows):
    return "\n".join(json.dumps(r) for r in rows)


#: A header that is quoted in part, a comma in quotes, an escaped null token, an escaped comma without quotes.
CSV = 'part,"remark"\n7,"long, thin"\n8,\\\\N\nodd \\,one,plain\n'


def make(top):
    """Writes them all below ``top``."""
    v = visits()
    out = {
        "boats.json": lines(boats()),
        "grids.json": lines(grids()),
        "visits.json": lines(v),
        "array.json": json.dumps(v, indent=2),
        "mixed.json": "\n".join([json.dumps(v[:3]), "[]", json.dumps(v[3]), json.dumps(v[4:5]), json.dumps(v[5:])]),
        "side.json": "".join(json.dumps(r) for r in v),
        "parts.csv": CSV,
        "shelf/one.csv": 'part,"remark"\n7,"long, thin"\n',
        "shelf/two.csv": "remark,part\n\\\\N,8\nplain,odd \\,one\n",
    }
    for name, text in out.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    for suffix in ("gz", "gzip"):
        (top / f"parts.csv.{suffix}").write_bytes(gzip.compress(CSV.encode()))
    return top
