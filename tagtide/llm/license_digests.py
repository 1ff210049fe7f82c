"""SHA-256 digests of the canonical forms (licenses.canonical) of whole licence texts, by SPDX short name.

GPL, LGPL and Apache-2.0 stand with and without the appendix after the end of their terms, and in the
variants of the publisher's address that distributions carry.
"""

DIGESTS = [
    ("Apache-2.0", "23c0498e738b86da84fa1ffb1ff43f4ef103f365367077ada18cd1db1813d6da"),
    ("Apache-2.0", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd"),
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("BSL-1.0", "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded"),
    ("BlueOak-1.0.0", "55e91aea016ab28d7112214004573a5f32b52d59881f746d83189c7b213357f3"),
    ("CC-BY-SA-4.0", "def99b23ba8930a02c111ffb99c0c4f55f9fd9bb38ad3ffe9df58fde3aac4247"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f"),
    ("GFDL-1.3", "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-2.0", "bc350e96593ab089ef5c714da6779ebe09eb2165d438ad2aee5c7df246607ae5"),
    ("GPL-2.0", "b0d56101d21747ea84ae93b3ebf7bc5b06ba29c85a2d969ee05dc884c2fe5ead"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", "e6a6b521df79eecdaa852ef89cab6ae3f9aa5aee3e1e26bfe41dfd4db36b4a76"),
    ("GPL-3.0", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943"),
    ("GPL-3.0", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f"),
    ("GPL-3.0", "a94e2ff60e71a491e5db95941fe28139a74d19b3f5a8689c616670ada3c84164"),
    ("LGPL-2.0", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    ("LGPL-2.0", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.1", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    ("LGPL-2.1", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
    ("WTFPL", "067bdb797cf86dc4a0b000155ee79caac0a641773169d0b45f2c7e2d1c0e6b79"),
]
