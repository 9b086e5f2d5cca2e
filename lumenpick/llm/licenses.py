"""Licence templates by SPDX identifier."""

from __future__ import annotations

_MIT_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_DISCLAIMS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
_ISC = _ISC_PERMISSION + "provided that the above copyright notice and this permission notice appear in all copies. " + _DISCLAIMS
_ZERO_BSD = _ISC_PERMISSION.replace("granted, ", "granted. ") + _DISCLAIMS
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_ADVERTISING = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
    "an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
    "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
    "and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_WTFPL = "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)


def _gnu_header(kind: str, version: str, later: bool, subject: str = "program") -> str:
    terms = f"either version {version} of the License, or (at your option) any later version. " if later else f"version {version} of the License. "
    return (
        f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, {terms}"
        f"This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    )


def _gnu(name: str, kind: str, version: str, date: str) -> dict[str, list[str]]:
    """A title or a notice without the words "or later" stands for the one version."""
    subject = "library" if kind.startswith("Lesser") else "program"
    year = date.rsplit(" ", 1)[-1]
    return {
        f"{name}-only": [
            _gnu_header(kind, version, False), _gnu_header(kind, version, False, subject),
            f"GNU {kind} Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc.", f"GNU {kind} Version {version}, {date}",
            f"This work is licensed under the GNU {kind}, version {version}", f"This {subject} is licensed under the GNU {kind}, version {version}", f"Licensed under the GNU {kind} v{version}",
            f"Licensed under the GNU {kind}, version {version} only",
        ],
        f"{name}-or-later": [
            _gnu_header(kind, version, True), _gnu_header(kind, version, True, subject), f"Licensed under the GNU {kind}, version {version} or later",
            f"Licensed under the GNU {kind}, version {version} or any later version",
        ],
    }


def _creative_commons(kind: str, short: str, version: str) -> list[str]:
    return [
        f"This work is licensed under a Creative Commons {kind} {version} International License",
        f"Licensed under {short} {version}",
        f"Creative Commons {kind} {version} International Public License",
    ]


# Titles, notices, headers and texts as the licences give or recommend them.
TEMPLATES: dict[str, list[str]] = {
    "0BSD": [_ZERO_BSD, "BSD Zero Clause License"],
    **_gnu("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", _APACHE_HEADER, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Released under the Apache License 2.0"],
    "BSD-2-Clause": [_BSD_2 + _BSD_WARRANTY, "BSD 2-Clause License"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD style license that can be found in the LICENSE file", _BSD_2 + _BSD_3 + _BSD_WARRANTY, "BSD 3-Clause License"],
    "BSD-4-Clause": [_BSD_2 + _BSD_ADVERTISING + _BSD_3.replace("3.", "4.") + _BSD_WARRANTY, "BSD 4-Clause License"],
    "BSL-1.0": [_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": _creative_commons("Attribution", "CC BY", "4.0"),
    "CC-BY-NC-4.0": _creative_commons("Attribution-NonCommercial", "CC BY-NC", "4.0"),
    "CC-BY-NC-ND-4.0": _creative_commons("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND", "4.0"),
    "CC-BY-NC-SA-4.0": _creative_commons("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA", "4.0"),
    "CC-BY-ND-4.0": _creative_commons("Attribution-NoDerivatives", "CC BY-ND", "4.0"),
    "CC-BY-SA-4.0": _creative_commons("Attribution-ShareAlike", "CC BY-SA", "4.0"),
    "CC0-1.0": ["CC0 1.0 Universal Public Domain Dedication", "Creative Commons CC0 1.0 Universal"],
    "EPL-1.0": ["Eclipse Public License - v 1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    **_gnu("GPL-2.0", "General Public License", "2", "June 1991"),
    **_gnu("GPL-3.0", "General Public License", "3", "29 June 2007"),
    "ISC": [_ISC, "ISC License", "Released under the ISC License"],
    **_gnu("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
    **_gnu("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"),
    "MIT": ["Released under the MIT License", _MIT_PERMISSION + _MIT_NOTICE + _MIT_WARRANTY, _MIT_PERMISSION, "The MIT License (MIT)", "MIT License Copyright (c)", "Licensed under the MIT License"],
    "MIT-0": [_MIT_PERMISSION.replace(", subject to the following conditions: ", ". ") + _MIT_WARRANTY, "MIT No Attribution"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "Unlicense": [_UNLICENSE, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "WTFPL": [_WTFPL, "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
    "Zlib": [_ZLIB, "The zlib License"],
}
