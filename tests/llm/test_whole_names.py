"""Names of more than two words, and with particles."""

import re

from pathloom.llm import pii_surrogates


def test_long_names(spark):
    text = "Dr. Anna Maria Schmidt, Mr. John Ronald Reuel Tolkien, Mr. Tolkien; Herr von Braun and Herr Karl von der Braun saw Mr Bob Mrs Lee."
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii_surrogates.replace(rows).collect()}
    m = re.fullmatch(r"Dr\. (\w+) (\w+) (\w+), Mr\. (\w+) (\w+) (\w+) (\w+), Mr\. (\w+); Herr von (\w+) and Herr (\w+) von der (\w+) saw Mr (\w+) Mrs (\w+)\.", got[1].text)
    assert m and got[1].n_name == 7, got[1].text
    assert not {"Maria", "Schmidt", "John", "Ronald", "Reuel", "Tolkien", "Braun", "Karl", "Bob", "Lee"} & {m[2], m[3], *m.groups()[4:9], m[11], m[12], m[13]}
    assert m[7] == m[8] and m[9] == m[11] and len(m[2]) == len("Maria")
