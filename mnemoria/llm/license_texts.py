"""License notices to scan for: (identifier, text).

Words in braces must be matched; ``<>`` stands for any few words, such as a holder's name.
The texts are the public standard notices and short references to them.
"""

TEMPLATES: list[tuple[str, str]] = [
    ("MIT-reference", "Released under the {MIT} License"),
    ("MIT-reference", "Licensed under the {MIT} License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining "
        "a copy of this software and associated documentation files, to deal "
        "in the {Software} without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall "
        "be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0-reference", "Licensed under the {Apache} License, Version {2}.0"),
    (
        "Apache-2.0",
        "Licensed under the {Apache} License, Version {2}.0; you may not use "
        "this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("GPL-3.0-reference", "This work is licensed under the {GNU} General Public License, version {3}"),
    ("GPL-2.0-reference", "This work is licensed under the {GNU} General Public License, version {2}"),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify "
        "it under the terms of the GNU {General} Public License as published by "
        "the Free Software Foundation, either version {3} of the License, or at "
        "your option any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify "
        "it under the terms of the GNU {General} Public License as published by "
        "the Free Software Foundation; either version {2} of the License, or at "
        "your option any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify "
        "it under the terms of the GNU {Lesser} General Public License as "
        "published by the Free Software Foundation; either version {2}.{1} of "
        "the License, or at your option any later version.",
    ),
    ("CC-BY-4.0-reference", "Licensed under {CC} {BY} {4}.0"),
    ("CC-BY-SA-4.0-reference", "Licensed under {CC} {BY}-{SA} {4}.0"),
    ("CC-BY-NC-4.0-reference", "Licensed under {CC} {BY}-{NC} {4}.0"),
    ("CC-BY-ND-4.0-reference", "Licensed under {CC} {BY}-{ND} {4}.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons {Attribution} {4}.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution {ShareAlike} {4}.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution {NonCommercial} {4}.0 International License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2}.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    (
        "BSD-2-Clause",
        "{Redistribution} and use in source and binary forms, with or without "
        "modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "{Redistribution} and use in source and binary forms, with or without "
        "modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "Neither the name of <> nor the names of its contributors may be used "
        "to endorse or promote products {derived} from this software without "
        "specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for "
        "any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied "
        "warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely",
    ),
    ("Unlicense", "This is free and unencumbered software released into the {public} domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("BSL-1.0", "Distributed under the {Boost} Software License, Version {1}.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the {Eclipse} Public License {2}.0"),
    ("SPDX-MIT", "SPDX License Identifier {MIT}"),
    ("SPDX-Apache-2.0", "SPDX License Identifier {Apache} {2}.0"),
    ("SPDX-GPL-3.0", "SPDX License Identifier {GPL} {3}.0"),
    ("SPDX-GPL-2.0", "SPDX License Identifier {GPL} {2}.0"),
    ("SPDX-BSD-3-Clause", "SPDX License Identifier {BSD} {3} Clause"),
]
