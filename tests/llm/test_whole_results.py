"""Inputs on which an operator once did less than the whole job."""

import brute_force as plain
from test_edge_cases import prose, table

from ridelake.llm import license_scan
from ridelake.llm.substring_dedup import drop_repeated_runs


def test_repeated_rows_that_repeat_another_document(spark):
    """A window marked once per copy of its row must not take words from the documents behind."""
    # Of 17 ids with one text, some share a chunk, as do some of them with clean documents.
    own = {**{i: prose(1, 60) for i in range(1, 18)}, **{i: prose(i, 60) for i in range(18, 60)}}
    own[17] = prose(17, 60) + " " + prose(17, 60)
    rows = [*own.items(), *[(i, own[i]) for i in range(2, 18) for _ in range(2)]]
    found = drop_repeated_runs(table(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = plain.repeated_runs(own.items())
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found} == {(i, *e) for i, e in expected.items()}


def test_licenses_that_are_wrapped_shared_or_embedded(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by"
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    texts = {
        1: f"/*\n * {bsd} so\n */\ncode follows",
        2: f"first line of code\n\n{gpl}\n# the foundation",
        3: f"{mit} {apache}",
        4: f"{prose(4, 4000)} {apache} {prose(5, 4000)} {mit} {prose(6, 4000)}",
        5: "This work is licensed under the GNU Affero General Public License, version 3.",
        6: "Released under the\n\nMIT License.",
        7: "Copyright 2024 ñ\nLicensed under CC BY-NC 4.0. All rights reserved.",
    }
    rows = table(spark, list(texts.items()))
    corpus = table(spark, [(i, "\n".join(prose(i * 100 + k, 12) for k in range(20))) for i in range(40)])
    model = license_scan.fit(corpus, plain_rows=500, template_rows=300)
    found = license_scan.find_licenses(rows, model).where("confirmed").collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found) == [
        (1, 1, "bsd"), (2, 2, "gpl"), (3, 0, "apache"), (3, 0, "mit"), (4, 0, "apache"), (4, 0, "mit"),
        (5, 0, "agpl"), (7, 1, "cc-by-nc"), (7, 1, "proprietary"),
    ]
    bodies = {(r.doc_id, r.family): r.body for r in found}
    assert bodies[3, "mit"] == mit[:-1] and bodies[4, "apache"] == apache[:-1]
    assert bodies[7, "proprietary"] == "All rights reserved"
    assert bodies[1, "bsd"] == bsd.removesuffix(" provided that")


def test_the_classifier_names_the_family_of_a_licence(spark):
    texts = {
        1: "Released under the MIT License.",
        2: "This library is licensed under the GNU Lesser General Public License, version 3.",
        3: "Anyone who obtains a copy of this software is hereby granted permission, free of charge, to use it",
        4: prose(9, 200),
    }
    rows = table(spark, list(texts.items()))
    corpus = table(spark, [(i, "\n".join(prose(i * 100 + k, 12) for k in range(20))) for i in range(40)])
    model = license_scan.fit(corpus, plain_rows=500, template_rows=300)
    found = {(r.doc_id, r.family, r.confirmed) for r in license_scan.find_licenses(rows, model).collect()}
    assert (1, "mit", True) in found
    assert (3, "mit", False) in found and {f for i, f, _ in found if i == 2} == {"gpl"}
    assert not [r for r in found if r[0] == 4]
    # Without weights nothing is proposed, however well a template agrees.
    blank = license_scan.LicenseModel(model.weights * 0, model.bias * 0, 1.0, 0.0)
    blank.bias[0] = 10.0
    assert license_scan.find_licenses(rows, blank).collect() == []
    # With the weights of two families changed over, the template of neither confirms.
    order = list(range(len(license_scan.FAMILIES)))
    i, j = license_scan.FAMILIES.index("mit"), license_scan.FAMILIES.index("bsd")
    order[i], order[j] = j, i
    swapped = license_scan.LicenseModel(model.weights[:, order], model.bias[order], model.temperature, 0.0)
    first = license_scan.find_licenses(rows.where("doc_id = 1"), swapped).collect()
    assert [(r.family, r.confirmed) for r in first] == [("bsd", False)]


def test_windows_are_scored_as_word_by_word(spark):
    """Sums over slices against the plain score of each window."""
    import numpy as np

    text = f"{prose(1, 300)}\n\nReleased under the MIT License.\n\n{prose(2, 90)}".encode()
    features = license_scan.Features.of([text])
    rng = np.random.default_rng(7)
    weights = rng.normal(size=(2 * license_scan.FEATURES + 1, len(license_scan.FAMILIES))).astype(np.float32)
    weights[-1] = 0
    model = license_scan.LicenseModel(weights, rng.normal(size=len(license_scan.FAMILIES)), 1.5, 0.0)
    expected = set()
    ends = np.append(features.first[1:], len(features.single))
    for begin, end in zip(features.first.tolist(), ends.tolist(), strict=True):
        for at in range(begin, end):
            for size in license_scan.WINDOWS:
                p = model.probabilities(features, at, min(at + size, end))
                if p[0] < license_scan.MAX_UNKNOWN:
                    expected.add((at, min(at + size, end), 1 + int(p[1:].argmax())))
    found = license_scan.proposed(features, model)
    assert set(zip(found.begin.tolist(), found.stop.tolist(), found.family.tolist(), strict=True)) == expected
