from ocellus.llm import licenses


def test_license_digests(spark):
    text = "Copyright (c) 2020 A\n\n" + licenses.MIT.replace("sublicense", "sub-license").upper()
    df = spark.createDataFrame([(1, text), (2, licenses.MIT + " more"), (3, None), (None, "")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.license_scan(df).collect()} == {1: "MIT", 2: None, 3: None, None: None}


def test_every_known_licence_under_title_and_copyright(spark):
    rows = []
    for name, bodies in licenses.KNOWN.items():
        for body in bodies:
            rows += [(name, body), (name, "Copyright (c) 2020 A B\n\n" + body), (name, f"{name} License\n\nCopyright 2020 A B\nAll rights reserved.\r\n\r\n" + body.replace("\n", "\r\n"))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.license_scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]
    assert {"MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"} <= set(licenses.KNOWN)


def test_titles_wraps_and_spellings(spark):
    bsd = licenses.KNOWN["BSD-3-Clause"][0].split("reserved.")[-1]
    mit = licenses.MIT
    texts = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 A\n\n" + mit), ("MIT", "The MIT License (MIT)\n\nCopyright 2020 A\n\n" + mit), ("MIT", "(The MIT License)\n\nCopyright A B\n\n" + mit.replace("merchantability".upper(), "MERCHANTIBILITY")),
        ("MIT", "# MIT Licence\n" + mit.replace(" copyright", "\ncopyright").replace(" COPYRIGHT", "\nCOPYRIGHT")),
        ("BSD-3-Clause", "Copyright (c) 2020, A\n" + bsd.replace("the copyright holder nor", "Some University nor").replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")),
        (None, "MIT License"), (None, "License"), (None, "Copyright (c) 2020 A\n" + mit + "\nnot for evil"), (None, "\n" * 50000 + "x"),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.license_scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]
