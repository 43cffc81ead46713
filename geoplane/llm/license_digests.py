"""SHA-256 of the canonical forms of common licenses, as ``license_variants`` gives them (fixed values)."""

DIGESTS = {
    "0933e9fdf25f8a4aced10e10246650350123e13b939182f69b5ec6730ce2d793": "Apache-2.0",
    "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9": "Apache-2.0",
    "53627ff6e5e71f06a7bbd1fe49056aaac341a73930de0f9492bc329acfa51af6": "Apache-2.0",
    "79706f536212a5c6597fbcdae5f34a4859620a1f65839bd18866ab385eb25968": "Apache-2.0",
    "88b509094dd0a67db0ae88fb7271c520829cf31eb4979739485494be57c109e9": "Apache-2.0",
    "a657010cc8660623635462386107381af70d2c7ec43ab36e27484c72cbb3b28f": "Apache-2.0",
    "bb531182159142b308d308fe34391e6848d93f2a2ed991087b686ec75f9dbb1d": "Apache-2.0",
    "bb86044f9e7259edb8a5a0b269bda8e8be4f5ab81e4ea0dd2c9c1ef461e25d84": "Apache-2.0",
    "c348fad4100086120c9a4f71602579f6f49d5ca97ae96d36cf377b10e6e79871": "Apache-2.0",
    "c936c3be4c0e23ce771b851922c44c2c6bbb0fb8c42f59ae99cf57ebd223697c": "Apache-2.0",
    "d5b3a6ea9e86cd8b2f4c477e554b2db2908d2a9f5a6e9134384931a5c9363300": "Apache-2.0",
    "fcd85ddd60a40dd8792b0fefafe7a0bab37adff71052e090a970313309c5625c": "Apache-2.0",
    "09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb": "Artistic-1.0-Perl",
    "4fb66e37b19b221c8d7775fd9b59e9c032bd72b47f4fe0002457d80247edd7ef": "Artistic-1.0-Perl",
    "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39": "Artistic-1.0-Perl",
    "a4ded8988ccbb4ad5cd1c456fb05c8c715750b157280d90781e42881f018301b": "Artistic-1.0-Perl",
    "b74d3ee983f6aecff5809b211f6fad079bccc1a257f2893fc62f3710b2277803": "Artistic-1.0-Perl",
    "d79559e25f380b6bd2f08a360d73bd343d418c6ba18ad37b23c4322552138e10": "Artistic-1.0-Perl",
    "dce473218f071e33d95a6d9fd8eef04043176d3f4b0c2f3d22b96d545467bea7": "Artistic-1.0-Perl",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
    "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2": "BSD-2-Clause",
    "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2": "BSD-2-Clause",
    "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74": "BSD-2-Clause",
    "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30": "BSD-2-Clause",
    "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9": "BSD-2-Clause",
    "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b": "BSD-2-Clause",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903": "BSD-3-Clause",
    "392246e155384d9db529e24a5e4421311edaa450732e6e33c6be0ec17df24769": "BSD-3-Clause",
    "4b87c86d316e4dc1567e2cfb30d9b7d61eed14da70f33f0d184729e9db27fb63": "BSD-3-Clause",
    "4e285b1614235043af9d3d27c09a8fdb6196f2b794b8c91dce361a5b4fb65b46": "BSD-3-Clause",
    "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa": "BSD-3-Clause",
    "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da": "BSD-3-Clause",
    "88795ac0b1bec6e0a46e3de7dd4549c44e46b8c1ec87c57fe3d0b8d26846953d": "BSD-3-Clause",
    "8dbfd105ddfdebd9a8e73d01342c6264aed2fa3a2052ca682161e64ca7e2d226": "BSD-3-Clause",
    "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2": "BSD-3-Clause",
    "9d35da508bc9f8b6c079a39f033dc94a53c80ef10a0e9499c6cbf55882ee5d3d": "BSD-3-Clause",
    "a06df82de55c78a283b2dd81105c51f24a3899ddd8e49a08a15b8e55885a36b2": "BSD-3-Clause",
    "bf29a39d9d83a77a7438e9e73578ec38fa6a7e3d24b344dc10a3c55a901d0117": "BSD-3-Clause",
    "ca467fbf5146e19371010b9a2f9eb038352a8e50b742834cd7e63297e6119a80": "BSD-3-Clause",
    "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15": "BSD-3-Clause",
    "db7eb212132cf8b09c0ac1aebfd4d908745eceb2821e2b49f5e3ce424d3c9293": "BSD-3-Clause",
    "e8b0c75e0d96f2588af121a6a836c426f0d54fec8876df7942e7e558d80dee15": "BSD-3-Clause",
    "f572d6b0df10a4e0c3e1bd6b50d24fc9beedf9cc09de6a67dfb7b3d13d0a85be": "BSD-3-Clause",
    "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af": "BSD-3-Clause",
    "13a06619caac563ef75dbb6b16c7b185cd8a7255a4c7134aecf15ed03eeb0b9e": "CC0-1.0",
    "bb878d68e2bd11ce5ffb0510fa88413b5dfd6d8fe1de780da66de6f74cf984af": "CC0-1.0",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a": "CC0-1.0",
    "24984a15a79852251f41674cbf7d55bce4ae838d119f0d6948fa83a46585ab5d": "GFDL-1.2",
    "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f": "GFDL-1.2",
    "48c73eca286e8f4cbc77d55f7cc9def7bbbd8deb1b814955542c5cd1f036bd8f": "GFDL-1.2",
    "5c1354865fd0e9f15123b13c783a290a98b16f74d4bf3211105798f10c463bce": "GFDL-1.2",
    "82aeeb3f6bdc347fe4613c4404682a7181c70eba3f75de70552cba62d0ba8e92": "GFDL-1.2",
    "da4c85448f47d22603d951c573ac545a667904a5f6eab0104964d422566c7ed2": "GFDL-1.2",
    "df4a7e18cb36653db66ec9376c2dd5d138aec376a4cce12d4424a526290733a8": "GFDL-1.2",
    "e356d537a163de7a639c7d41d362773d2b9a66922055a30dbd56734601966fc0": "GFDL-1.2",
    "1f2021076bd507aed0cd904fc366e864f59df0192d296965d6b993c087505c56": "GFDL-1.3",
    "1fdd53f1ef0ad288d6e9388b799ce36ae0484d524c9a2d2408a6f2f8e6dc5cef": "GFDL-1.3",
    "25f30ac6408a43f1ad74cd9289046a5a461801a21d87d2ff9f05daa2128bc646": "GFDL-1.3",
    "575fc1ad0582e8377075a0d043de9079af1394052c40cf38867eb55d1257081b": "GFDL-1.3",
    "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4": "GFDL-1.3",
    "bc882955885bd3e89f2ef05a0446e40db189a071714b8f691921a6f55721269c": "GFDL-1.3",
    "c67346bb782ea124108a000b780b0793910ce04f8dbb8b4a2b0b9a2bc5357bc9": "GFDL-1.3",
    "dff2bf98942fe760bfe5e6bf75a830b0acbc015c8adb0b2bc9d9af2721bbca5d": "GFDL-1.3",
    "175f511abd0d3fd5f48cd40e0aaac24652ada233ca289e42f8ffdc9dd5eb8a0e": "GPL-1.0",
    "37a8d6ceffb74a4cd60be1028e4d7d9cc0b1682c4aa3c1d9efd628dc5460f60b": "GPL-1.0",
    "422dc6ece1afadb367f2bcdbf6ac496f4c7ad5c973c45cdd09ae377ceb4c8a12": "GPL-1.0",
    "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc": "GPL-1.0",
    "526a998a5f0ae9ed2e8c2dc03c12942fc9d724df13b0787dd3c80881d3688444": "GPL-1.0",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5": "GPL-1.0",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0",
    "8f3791039a137dc41a4222725079093e91fe98d5b92a8a4c0619e88addd253c6": "GPL-1.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d": "GPL-1.0",
    "fc950c23f45be4cbd4fc1ad2acb57c168d4c44f3006950d121e6755e704ac00d": "GPL-1.0",
    "07f9dc67ef43f8488ad21cd89644097f06a71dca46dd84f7c712db10702b0dea": "GPL-2.0",
    "19329ee16e4a9fb2e74ce40708e49f5c315b4f0ac4653c556ca42027ba79f9f5": "GPL-2.0",
    "4646298f1f69486a71cbb9951aa491f173f0a25d76adfb9a1560a08c75f15daf": "GPL-2.0",
    "51784fcce02e3d6a52a2ec0260f583b9d573810cf33e46bd16fd6a821b36760b": "GPL-2.0",
    "98e760555ff723908d803b23140ebd264fee15e7615bf9486faa0f8f6596c34f": "GPL-2.0",
    "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017": "GPL-2.0",
    "b6c0cac88d1c4ab1320f2eba6d8ca1b8701ea66d005555e1a7ecd05f28ddfd5b": "GPL-2.0",
    "b7f81dc9aaaa645304fde476859dc46db4e23b83ec1c50bd8462652ff46110c9": "GPL-2.0",
    "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1": "GPL-2.0",
    "c928252f428993b646c70c671425ec87aab1bc5abf42e7a179685a96469bd918": "GPL-2.0",
    "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999": "GPL-2.0",
    "e7bc7b2c2e4b763c9c6ceb90a3984a8273193cd39747fbab315ee26296ddd602": "GPL-2.0",
    "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f": "GPL-3.0",
    "3129d737330c12f3281f0f8fcd4799ddbc6f254181868ae29d6ca65827f0682b": "GPL-3.0",
    "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943": "GPL-3.0",
    "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b": "GPL-3.0",
    "7300741b7882c4cee1198306545302285397b5dbcfa263d41588b8b85e01aefd": "GPL-3.0",
    "80d2bf43efa136ac2e7270ccf874f8bcfa290c73ed98846547ea57c88da9dc77": "GPL-3.0",
    "890533e0e9e49f211db7a6295286b6854ac5f5560fef95c46bfc99c15cca3c70": "GPL-3.0",
    "a0c2cdaf70f40600e3352db5bfcd3a8d1e4d5ea6ba0aa3f799328067494929ae": "GPL-3.0",
    "bd0a51b1879c5ef290541425f811ff5c57e53784e866a9d70a635e8fbcaade54": "GPL-3.0",
    "be6cf54fefdf7da1142be7b1618883afb88c7df4b5e6b39786326b10aed10940": "GPL-3.0",
    "c0c9bd5f6daa38ab99b2393ea1bf3fa29104890d97df6f0e6ee8151c8ea15e08": "GPL-3.0",
    "fad6d14122ae5943ea05f9e4d48194524a0b701f034fd22c7dded3e6c296c742": "GPL-3.0",
    "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a": "ISC",
    "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db": "ISC",
    "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee": "ISC",
    "052bf540c98a4842bad8d9f2b372e7225b1eb1d38da3916a60bc288db5e37152": "LGPL-2.0",
    "4cb9b3374c19e11e661a04fa4a8694f82168f4507728e0db630b16375a598a4f": "LGPL-2.0",
    "52c6f7dfc07e1c0b5d4cf107d72cff9e7fa07a420fcc705573c50f0fac5a726b": "LGPL-2.0",
    "5d5e835dc058a7da602999c412a08b84d73452108446791df08b08b89b65d19b": "LGPL-2.0",
    "60e9e814f1805fdf9bff6f397e265654a66d4bcfaa9ee4e44c8a2977fdc1f978": "LGPL-2.0",
    "68060ac3df6b7fb29d4ae0307b72de859290da2fd8b64cc670d9510b7ce064f1": "LGPL-2.0",
    "7fc97fe11e6e5b00aaa7648d69ce54578838736d91831192ef25f716399748dd": "LGPL-2.0",
    "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3": "LGPL-2.0",
    "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499": "LGPL-2.0",
    "e7ecb08f240f58455c2c9090ab912b4bb92385869e21cf6d5eddcdcfc74a1731": "LGPL-2.0",
    "f51728eb856e51e6247d4a023256f9cb9322abe784bdb65ecb82131ef29bfcee": "LGPL-2.0",
    "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c": "LGPL-2.0",
    "24d19e66ab32f41a145f56a8593767d2ea12c55c735ff6dc1aeb899f0a446c92": "LGPL-2.1",
    "359509cf11d8ff3c5d1dcc9af8aef0449aa2f4665124a5f19daa9990ee1c77eb": "LGPL-2.1",
    "423978a4441f371091052e1e5f2731da425f4761edb5a121eb506d5f6bcc78f2": "LGPL-2.1",
    "482f979099bf3ec56dd29f3fc67c705f21d132836063a2d2db55fd83c2057ca1": "LGPL-2.1",
    "6d05f602d7a9f9950f9537100bd504a7fdab92cfe89f4f94b0d15721ee014b1f": "LGPL-2.1",
    "8582c8c9916875b228bdd774fd968589c70e8c6acaff3326ce5e17d74d506e3d": "LGPL-2.1",
    "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c": "LGPL-2.1",
    "98ee2ec068a51049ed400919bcc9b031bd9fcb4141726f51e23b5f0196a2d37a": "LGPL-2.1",
    "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd": "LGPL-2.1",
    "9c8aea52ac2706a35452528904b5cef7c0aa4140e5ec04d54ba60f53c4a5c78b": "LGPL-2.1",
    "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345": "LGPL-2.1",
    "f9d8c63510acadfc6b74bb2f6da8f29ced84841c43b4548b8aa673c7d43abba9": "LGPL-2.1",
    "11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8": "LGPL-3.0",
    "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7": "LGPL-3.0",
    "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a": "LGPL-3.0",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c": "MIT",
    "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164": "MIT",
    "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f": "MIT",
    "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127": "MIT",
    "2772c161a7ca5eceb4517ee311d5ee8b30c97502771ed5f826ca5e3856ad5c11": "MPL-1.1",
    "286531471d44d2304f376f72d62a3573a9a54a8693a2d7cc3c3ed45fd567e8c5": "MPL-1.1",
    "309644652230be9819f5899f1a5c23a62de37dd2c491aed7e11d0ec476dcd3a0": "MPL-1.1",
    "3b27c5aec45c4ad420349e8f7d6d60b3c36684a180716e41ff2090cd3632a471": "MPL-1.1",
    "8e0d6bce1c9edcccd142522e83c6de084a68b9500d79e6741b8903df3316c55a": "MPL-1.1",
    "bda5b12dc72922ac1a9cd44dfd930bb86c92b2c4d78ad0be6c1ad9cfa7d0663d": "MPL-1.1",
    "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6": "MPL-1.1",
    "fb84cdb331a381edd811d3017d5400ac2c74d9d8470038f79413ac78b10c2a59": "MPL-1.1",
    "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04": "MPL-2.0",
    "48d4c0c134eba12fe76395f32d60c0a361aaff3d5c85fd71fd8f51717387d0cb": "MPL-2.0",
    "69b2403d1e65116a809c153afcdfbd7189770071966d66fb94619c9dbe591b5f": "MPL-2.0",
    "81359d68dd6decf41fb63a39c901f382e373771e6263680d3e16e55a44fca678": "MPL-2.0",
    "958f21dc8dffc8ff8e2cd52fee0a8a694d6cbc45344ba2aa6e9802e632a8fc03": "MPL-2.0",
    "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9": "MPL-2.0",
    "e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2": "MPL-2.0",
    "fa31bb5fe4dacb07f1a4ad162be58edb552e9a96a500b68e081943eb2d3cfec5": "MPL-2.0",
    "6077a8a20d606206e486caec85a30b2545701071b1e08d12c37fb9a0e490d1bf": "Unlicense",
    "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd": "Unlicense",
    "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7": "Zlib",
    "650ad42ca78a7de669d6cdb6370d08407db85fb523ec1120eac8064af9d15be0": "Zlib",
    "6639a2a838439b2f70d60db893a595aca137c59bd50f4b6f5ec2be9ada5db66e": "Zlib",
    "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a": "Zlib",
    "9ddc78a5797b5008d488969fd959f4281a97821e07ddc5d19ca9c163fdbeeb73": "Zlib",
    "ee37bc3ccba61ff28a10c05f28bdabf7466db400a75d9a1890fb865cda23e145": "Zlib",
}
