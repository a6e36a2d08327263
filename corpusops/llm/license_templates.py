"""Wording of published licenses and of the notices by which files name them, in the markup of ``license_scan``.

Wording is as published; what the licenses leave to be filled in, numbers of clauses and phrases that come and go are marked.
"""

from __future__ import annotations

_CC_VERSION = "<<var;name=version;match=1 0|2 0|2 5|3 0|4 0>>"
_CC_KIND = "<<beginOptional>><<var;name=kind;match=international|unported|generic|public>><<endOptional>>"
_LATER = """of the license <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"""
_DISCLAIMER = """this software is provided by <<var;name=holder;words=1-12>> as is and any express or implied warranties including but not
    limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
    <<var;name=holder;words=1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including
    but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused
    and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way
    out of the use of this software even if advised of the possibility of such damage"""
_CONDITIONS = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met <<beginOptional>><<var;name=number;match=1|a>><<endOptional>> redistributions of source code must retain the above
    copyright notice this list of conditions and the following disclaimer <<beginOptional>><<var;name=number;match=2|b>><<endOptional>>
    redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in
    the documentation and or other materials provided with the distribution"""


def _cc(terms: str) -> str:
    return f"""licensed under <<beginOptional>><<var;name=article;match=a|the>><<endOptional>> creative commons attribution {terms}
        {_CC_VERSION} {_CC_KIND} <<beginOptional>>license<<endOptional>>"""


def _gnu(work: str, name: str, versions: str) -> str:
    return f"""this {work} is free software you can redistribute it and or modify it under the terms of the gnu {name} general public
        license as published by the free software foundation <<beginOptional>>either<<endOptional>> version
        <<var;name=version;match={versions}>> {_LATER}"""


NOTICES = {
    "agpl-header": _gnu("<<var;name=work;words=1-3>>", "affero", "3|1"),
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at <<var;name=address;words=1-10>> unless required by applicable law or agreed
        to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any
        kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
    "cc-by-licensed": f"licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by {_CC_VERSION}",
    "cc-by-notice": _cc(""),
    "cc-by-nc-notice": _cc("<<var;name=nc;match=noncommercial|non commercial>>"),
    "cc-by-nc-nd-notice": _cc("<<var;name=nc;match=noncommercial|non commercial>> <<var;name=nd;match=noderivs|noderivatives|no derivatives>>"),
    "cc-by-nc-sa-notice": _cc("<<var;name=nc;match=noncommercial|non commercial>> <<var;name=sa;match=sharealike|share alike>>"),
    "cc-by-nd-notice": _cc("<<var;name=nd;match=noderivs|noderivatives|no derivatives>>"),
    "cc-by-sa-notice": _cc("<<var;name=sa;match=sharealike|share alike>>"),
    "cc0-notice": """to the extent possible under law <<var;name=person;words=1-16>> <<var;name=verb;match=has|have>> waived all copyright and
        related or neighboring rights to""",
    "cc0-universal": "cc0 1 0 universal <<beginOptional>>public domain dedication<<endOptional>>",
    "lgpl-header": _gnu("<<var;name=work;words=1-3>>", "<<var;name=kind;match=lesser|library>>", "2|2 0|2 1|3|3 0"),
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
        with this file you can obtain one at""",
}

BODIES = {
    "bsd-2-clause": f"{_CONDITIONS} {_DISCLAIMER}",
    "bsd-3-clause-full": f"""{_CONDITIONS} <<beginOptional>><<var;name=number;match=3|c>><<endOptional>> neither the name of
        <<var;name=owner;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission {_DISCLAIMER}""",
    "isc-full": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies the software is provided as is and
        <<var;name=holder;words=1-10>> <<var;name=verb;match=disclaims|disclaim>> all warranties with regard to this software including all implied warranties of merchantability
        and fitness in no event shall <<var;name=holder;words=1-10>> be liable for any special direct indirect or consequential damages
        or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
    "mit-full": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do
        so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next
        paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is
        without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a
        particular purpose and <<var;name=spelling;match=noninfringement|non infringement>> in no event shall <<var;name=holder;words=1-12>> be liable for any claim damages or other
        liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
        other dealings in the software""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell
        or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and
        by any means""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely subject to the following restrictions""",
}
