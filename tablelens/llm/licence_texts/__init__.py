"""Whole licence texts (the .txt files beside this one) and the usual headers of source files, by licence.

The whole text of AGPL-3.0 is no file: it is made of GPL-3.0's with the passages that tell them apart, not verbatim. The
legal code of CC BY, CC BY-SA and CC BY-NC 4.0 is not here; these are known by their statements and identifiers only."""

from __future__ import annotations

import re
from pathlib import Path

_GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details.

You should have received a copy of the GNU {name}
along with this program.  If not, see <https://www.gnu.org/licenses/>."""

_GNU_ONLY = _GNU.replace("either version {version} of the License, or\n(at your option) any later version.", "version {version} of the License.")

_GNU_OLD = _GNU.replace("along with this program.  If not, see <https://www.gnu.org/licenses/>.", """along with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""")

HEADERS = {
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""", """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""],
    "BSD-3-Clause": ["""Copyright (c) The Authors. All rights reserved.
Use of this source code is governed by a BSD-style
license that can be found in the LICENSE file."""],
    "MIT": ["""Copyright (c) The Authors. All rights reserved.
Licensed under the MIT License. See License.txt in the project root for license information."""],
    "MPL-2.0": ["""This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""],
} | {
    licence: [form.format(name=name, version=version) for form in (_GNU, _GNU_ONLY, _GNU_OLD)]
    for licence, name, version in (
        ("AGPL-3.0", "Affero General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"))
}


_REMOTE = """Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this
License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a
computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by
providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of
facilitating copying of software."""


def long_templates() -> list[tuple[str, str]]:
    """(licence, text) of all whole texts and headers."""
    whole = {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).parent.glob("*.txt"))}
    affero = re.sub(r"(?i)(GNU )(General Public License)", r"\1Affero \2", whole["GPL-3.0"]) + _REMOTE
    return [*whole.items(), ("AGPL-3.0", affero)] + [(name, text) for name, texts in HEADERS.items() for text in texts]
