"""Sentences that the licence classifier learns from."""

from __future__ import annotations

# Sentences of public licence texts and of the notices that go with them, by family.
TEXTS = {
    "AGPL-3.0": [
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
    ],
    "Apache-2.0": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license.",
        "The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files.",
    ],
    "BSD": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Redistribution and use of this software in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES, HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.",
        "Redistribution and use in source (SGML DocBook) and 'compiled' forms (SGML, HTML, PDF, PostScript, RTF and so forth) with or without modification, are permitted provided that the following conditions are met:",
        "in source and binary forms, with or without modification",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY": [
        "This work is licensed under the Creative Commons Attribution 3.0 Unported License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution license.",
        "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit. CC BY.",
        "Open access article distributed under the terms of the Creative Commons Attribution License (CC BY), which permits unrestricted use, provided the original author and source are credited.",
    ],
    "CC-BY-NC": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 3.0 Unported License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "You may not use the material for commercial purposes. CC BY-NC.",
        "Open access article distributed under the Creative Commons Attribution Non-Commercial License (CC BY-NC), which permits non-commercial use.",
    ],
    "CC-BY-SA": [
        "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original. CC BY-SA.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC0": [
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law. CC0.",
        "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work.",
        "No copyright. You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission. CC0 1.0.",
        "To view a copy of this waiver, visit http://creativecommons.org/publicdomain/zero/1.0/",
    ],
    "GPL": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice.",
        "This file is part of free software, which you may redistribute under the GNU General Public License.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
        "Copyright (c) Internet Systems Consortium, Inc. (\"ISC\")",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
        "This license, the Lesser General Public License, applies to some specially designated software packages, typically libraries, of the Free Software Foundation.",
        "A program that contains no derivative of any portion of the Library, but is designed to work with the Library by being compiled or linked with it, is called a \"work that uses the Library\".",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE.",
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining",
        "obtaining a copy of this software, to deal in the Software without restriction",
    ],
    "MPL-2.0": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
        "The contents of this file are subject to the Mozilla Public License Version 2.0; you may not use this file except in compliance with the License.",
    ],
    "Proprietary": [
        "Copyright 2021 Example Corporation. All rights are reserved.",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form without the prior written permission of the publisher.",
        "This document contains confidential and proprietary information and may not be disclosed or reproduced without written consent.",
        "Unauthorized copying, distribution or use of this material is strictly prohibited. All rights reserved by the publisher.",
        "The authors reserve all rights. This material may not be reproduced without permission.",
        "All rights reserved worldwide.",
        "Copyright (c) 2020 the authors, all rights reserved",
    ],
    "Unlicense": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "For more information, please refer to <http://unlicense.org/>",
        "This is free and unencumbered software, put into the public domain by its authors.",
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. Unlicense.",
    ],
}
# How families are named where a notice only names them.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0", "GNU AGPL", "AGPL"],
    "Apache-2.0": ["Apache License", "Apache License 2.0", "Apache-2.0 license", "Apache Software License, Version 2.0", "Apache 2.0"],
    "BSD": ["BSD license", "3-clause BSD license", "New BSD License", "BSD-2-Clause", "BSD-3-Clause license", "modified BSD license"],
    "CC-BY": ["CC BY 3.0", "CC-BY license", "Creative Commons Attribution License", "CC BY 4.0 license", "Creative Commons Attribution 4.0 International"],
    "CC-BY-NC": ["CC BY-NC 3.0", "CC-BY-NC license", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-SA": ["CC BY-SA 3.0", "CC-BY-SA license", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC0": ["CC0", "CC0 license", "CC0 1.0 Universal license", "CC0 public domain dedication"],
    "GPL": ["GNU General Public License", "GPL", "GNU GPL", "GPLv3", "GPLv2", "GPL version 2", "GPL-3.0 license", "GNU General Public License, version 2", "GNU General Public License v3"],
    "ISC": ["ISC license", "ISC-style license", "ISC"],
    "LGPL": ["GNU Lesser General Public License", "LGPL", "GNU LGPL", "LGPLv3", "LGPL-2.1", "GNU Library General Public License, version 2"],
    "MIT": ["MIT license", "MIT-style license", "MIT", "MIT X11 license", "Expat license"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0 license"],
    "Unlicense": ["Unlicense", "Unlicense license"],
}
# Notices that name a licence; the last two are left to the short forms.
FRAMES = ["Licensed under {}.", "Licensed under the {}.", "This project is licensed under the {}", "Distributed under the terms of the {}.", "This software is available under the {}.", "The code may be used under the {}.", "License: {}", "SPDX-License-Identifier: {}"]
# Licences of other families, which are to be unknown.
OTHERS = [
    "zlib License", "Boost Software License 1.0", "Eclipse Public License 2.0", "Artistic License 2.0", "SIL Open Font License 1.1", "European Union Public Licence 1.2", "Microsoft Public License", "PostgreSQL License",
    "Common Development and Distribution License", "Python Software Foundation License", "Academic Free License 3.0", "Educational Community License", "Ruby License", "PHP License 3.01", "Open Data Commons Open Database License", "Sleepycat License",
]
# Sentences of such licences, and licence talk of no family.
OTHER_TEXTS = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "The Font Software may not be modified, altered, or added to unless the fonts are renamed to names not containing the reserved words.",
    "Each Recipient under this Agreement receives the rights of a Contributor to the Program.",
    "The Work may be used by the Licensee under this Licence of the European Union.",
]
TALK = [
    "The driver lost his license after the accident.", "A software license must be bought for each user.", "Read the license before you copy anything.", "The license of the shop was renewed last year.",
    "Permission to build was granted by the town.", "The copyright of the song was sold.", "A new public library opened in the general hospital.", "All rights come with duties.", "The Apache helicopter landed.",
    "MIT students built a robot.", "Creative people share ideas.", "Redistribution of wealth is debated.", "The licensed pharmacy is open.", "Version 3 of the public plan was reserved for members.", "Copyright notice.", "License agreement.",
    "He holds a fishing license.", "The pilot's license expired.", "The bar has no license to sell wine.", "They fight for equal rights.", "License plates are checked at the border.", "Her driving licence is in the car.", "The licence fee was raised.", "Copyright law is taught in the second year.",
]
# Plain prose, which is about no licence.
PROSE = [
    "The weather was fine and we walked along the river until it was dark.", "She opened the window and looked at the street below.", "In the morning the children went to school by bus.", "It is not known how many people live in the village.",
    "This is the first time that the team has won the game.", "You can find more information on the next page of the report.", "The company said that it would open a new office in the city.", "He may use the car for work, but not on other days.",
    "All of them were tired after the long day, and so they went to bed.", "The results of the study are shown in the table.", "If you want to know more, please ask at the desk.", "A copy of the letter was sent to the office by post.",
    "The work was done by a small group of students.", "We are free to go where we like at any time.", "There is no change in the number of visitors this year.", "It was written in the hope that someone would read it.",
    "The program starts at eight and ends at ten.", "Any person who comes late must wait outside.", "They found the original source of the river in the mountains.", "The author of the book gave a talk about her life.",
    "The same conditions apply to all members of the club.", "Without doubt this was the best part of the trip.", "Some words of the text are hard to read.", "The public was not allowed to see the form of the statue.",
    "More than half of the files were lost in the fire.", "The following day we had to use another road.", "He made a list of the names of his friends.", "For this purpose a special room was built.",
    "The general use of such tools is limited by their price.", "In case of rain the party will be held in the house.", "At the end of the year the final version was ready.", "As far as possible, keep the food in a cool place.",
    "He went with his friends from the station to the park or the lake.", "What do you want to do with the rest of the day?", "She looked under the bed and behind each door before leaving.", "Either they have lost its key, or the last person kept it.",
    "Even so, we agreed to come back and deal with it later.", "They have not called since, nor did they say anything.", "The kind of data that each computer holds is not the same.", "Do not be late, and come with all your things from home.",
    "Er kam mit dem Zug und ging mit seiner Mutter nach Hause.", "Wir sprechen mit dem Lehrer über die Schule.", "Ella salió con su hermano de la casa.", "Il est parti avec sa sœur sans dire un mot.",
    "Der Zug kam spät an, und wir mussten lange warten.", "Die Kinder spielen im Garten, weil die Sonne scheint.", "Elle a trouvé la maison de son grand-père dans le village.", "Le soir, nous avons mangé du pain et du fromage.", "El perro corre por la calle y los niños ríen.", "La casa de mi abuela está cerca del mar.",
]
