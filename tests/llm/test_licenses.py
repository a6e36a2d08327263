"""Published notices and license bodies are accepted, and rejected with any mandatory word changed."""

import pytest

from corpusops.llm import license_scan, license_templates

LATER = "either version {} of the License, or (at your option) any later version."
GNU = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation; "
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
PUBLISHED = {
    "lgpl-header": GNU.format("library", "Lesser") + LATER.format("2.1"),
    "agpl-header": GNU.format("program", "Affero") + LATER.format("3"),
    "gpl-header": GNU.replace("GNU {} General", "GNU General").format("program") + LATER.format("2"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-sa-notice": "licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License",
    "cc0-notice": "To the extent possible under law, Jo Doe and others have waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-2-clause": BSD_CONDITIONS + BSD_DISCLAIMER,
    "bsd-3-clause-full": BSD_CONDITIONS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + BSD_DISCLAIMER,
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


@pytest.fixture(scope="module")
def scanner():
    return license_scan.LicenseScanner(license_scan.TEMPLATES, license_scan.PHRASES)


@pytest.mark.parametrize("label", sorted(PUBLISHED))
def test_published_wording(scanner, label):
    assert label in {s[0] for s in scanner.scan("Some file.\n/* " + PUBLISHED[label].replace("\n", "\n * ") + " */ more")[2]}


def _room(parts):
    """Words that may stand in marked regions, at most."""
    return sum(p[2] if p[0] == "any" else max(map(len, p[1])) if p[0] == "choice" else len(p[1]) + _room(p[1]) if p[0] == "optional" else 0 for p in parts)


@pytest.mark.parametrize("label", sorted(PUBLISHED))
def test_a_changed_mandatory_word_is_rejected(scanner, label):
    """Each word is changed alone: what is still accepted up to the same end fits into the marked regions."""
    markup = license_scan.TEMPLATES[label]
    automaton, words = license_scan.TokenAutomaton(markup), license_scan.words_of(PUBLISHED[label])
    start = next(i for i in range(len(words)) if automaton.match(words, i))
    end = automaton.match(words, start)
    kept = [i for i in range(start, end) if automaton.match(words[:i] + [b"changed"] + words[i + 1 :], start) == end]
    room = _room(license_scan.parse_template(markup))
    assert len(kept) <= room < end - start


def test_labels_are_told_apart(scanner):
    found = lambda text: {s[0] for s in scanner.scan(text)[2]}
    assert "bsd-2-clause" not in found(PUBLISHED["bsd-3-clause-full"]) and "bsd-3-clause-full" not in found(PUBLISHED["bsd-2-clause"])
    assert "gpl-header" not in found(PUBLISHED["lgpl-header"]) | found(PUBLISHED["agpl-header"])
    assert found(PUBLISHED["cc-by-nc-sa-notice"]) & set(license_templates.NOTICES) == {"cc-by-nc-sa-notice"}
