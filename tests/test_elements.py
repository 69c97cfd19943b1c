"""Elements as rows: nesting, what is left open, scripts, and people by class."""

from sitewright.operators import dom

PAGE = """<body class=all><h1>Top <b>one</b></h1><div class="h-card x"><p class="p-name">Anna <i class=fn></i></p><span class="p-name"> Rossi</span><br class=name>
<div class="h-card"><span class=fn>Paola Verdi</span><span class=role>Boss</span></div></div><script class=s>var a="<p class=no>";</script>
<div class="team"><p class=person>Marco Neri, CEO<h3>Ugo Bianchi, Founder</div><h2 class=title>after &amp; end"""


def test_elements_are_intervals():
    rows = {(r[2], tuple(r[3])): r for r in dom.page_elements(PAGE)}
    assert rows["h1", ()][4] == "Top one" and rows["body", ("all",)][4].endswith("after & end") and "var a" not in rows["body", ("all",)][4]
    outer, inner = rows["div", ("h-card", "x")], rows["div", ("h-card",)]
    assert outer[0] < inner[0] <= inner[1] <= outer[1] and rows["span", ("role",)][0] <= inner[1] < rows["h3", ()][0]
    assert rows["p", ("person",)][4] == "Marco Neri, CEOUgo Bianchi, Founder" and rows["div", ("team",)][1] == rows["h3", ()][0] and rows["br", ("name",)][4] == ""
    assert dom.page_elements("") == [] and dom.page_elements("</p></div>plain") == [] and dom.page_elements("<p class=a>x")[0][4] == "x"


def test_people_by_class(spark):
    data = '<script type="application/ld+json">[{"@type":"Person","name":" Dora  Lanza "},{"name":3,"author":{"name":"Luisa Moreau","role":"CEO"}}]</script>'
    pages = spark.createDataFrame([("a.it", 1, PAGE), ("b.it", 2, data + data), ("c.it", 3, None), ("c.it", 4, "no people"), ("a.it", 5, "<p class='h-card'><b class=name>Élodie Roche</b></p>")], "site string, page_id long, html string")
    got = sorted((r.page_id, r.channel_ord, r.hit_ord, r.title, r.first, r.last, r.weight) for r in dom.dom_people(pages).collect())
    assert got == [
        (1, 2, 0, "Boss", "Paola", "Verdi", 1), (1, 3, 0, got[1][3], "Marco", "Neri", 2), (1, 3, 1, "Marco Neri, CEOUgo Bianchi, Founder", "Marco", "Neri", 2), (1, 3, 2, "Ugo Bianchi, Founder", "Ugo", "Bianchi", 2),
        (2, 1, 0, "Person", "Dora", "Lanza", 1), (2, 1, 1, "CEO", "Luisa", "Moreau", 3), (2, 1, 2, "Person", "Dora", "Lanza", 1), (2, 1, 3, "CEO", "Luisa", "Moreau", 3),
    ]
