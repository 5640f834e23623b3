"""Standard headings and notices get their labels, other texts that share their words do not."""

import pytest

from tidemill.llm import licenses

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
{2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."""
CASES = [
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", {"apache", "apache-2.0"}),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", {"lgpl-3.0"}),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", {"lgpl-2.1"}),
    ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", {"agpl-3.0"}),
    ("under version 3 of the GNU General Public License", {"gpl", "gpl-3.0"}),
    ("the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", {"gpl", "gpl-3.0"}),
    ("Mozilla Public License Version 2.0", {"mpl-2.0"}),
    ("subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file", {"mpl-2.0"}),
    ("Eclipse Public License - v 2.0", {"epl-2.0"}),
    ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0", {"cddl-1.0"}),
    ("Boost Software License - Version 1.0 - August 17th, 2003", {"bsl-1.0"}),
    ("SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007", {"ofl-1.1"}),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES',
        {"isc"},
    ),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either", {"unlicense"}),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for", {"zlib"}),
    (BSD.format("1.", "2.", "3."), {"bsd", "bsd-3-clause"}),
    (BSD.format("*", "*", "*"), {"bsd", "bsd-3-clause"}),
    (BSD[: BSD.index("{2}")].format("1.", "2."), {"bsd"}),
    ("// SPDX-License-Identifier: MIT", {"mit"}),
    ("# SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0"}),
    ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", {"cc-by-nc-sa-4.0"}),
    ("licensed CC BY 4.0", {"cc-by", "cc-by-4.0"}),
    ("CC BY-SA 4.0", {"cc-by", "cc-by-sa-4.0"}),
    ("the lesser general public was given a license, version 3 of it", set()),
    ("apache is version 2.0 of nothing; a public license of Mozilla's", set()),
    ("GNU General Public License, and much later on, in a chapter about other things, we meet version 3 of the book", {"gpl"}),
    ("permission to use, copy, modify is not granted; the software is provided in a box", set()),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    return {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_labels(scanned, case):
    assert set(filter(None, scanned[case].labels.split(","))) == CASES[case][1]


def test_templates_are_many_and_their_places_grow():
    every = licenses.notices()
    assert len({label for label, _ in every}) >= 30
    assert all(a < b for _, phrases in every for (a, _), (b, _) in zip(phrases, phrases[1:], strict=False))
