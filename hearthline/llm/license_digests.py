"""SHA-256 of whole licences in canonical form (``licenses.canonical_line``), with and without their titles and appendices.

Made from the published texts; BSD-2/3-Clause with and without numbers of the clauses, and with their usual namings of the holder.
"""

DIGESTS = (
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("0BSD", "53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe"),
    ("0BSD", "843df9be100ab21a2776200c2594361c829160bb555f44ab1bcdc07b87066bee"),
    ("0BSD", "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153"),
    ("Apache-2.0", "2136ccf013476faf84009ad5c667369e6718de5a3d755f97ad14c74f000e9f6f"),
    ("Apache-2.0", "46262ed7a2a06fdac885b37f111be9b18bbde572ab1edbd2f416d673551ab967"),
    ("Apache-2.0", "62c23944e22c7e1579b00eab372c8062d04f03e360aaab08b4030b71d5eac153"),
    ("Apache-2.0", "b0a60aaffc83b2bdcebe90ae6d33365e374a9bf69e8c2e80c0e8c51256d4fc93"),
    ("Apache-2.0", "cde7bc24bdbd45dc163ffe3310ac18828bc61ca29d7022e5423fc27c782c807a"),
    ("BSD-2-Clause", "10677e704f35e9d68ab40192dc9035db9a743691d71ad0f39d1ae44a81d27e98"),
    ("BSD-2-Clause", "117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe"),
    ("BSD-2-Clause", "18a4ded338bbc2e1519cd794de3c17e3d5fe9628e240824c584fecdebe777a72"),
    ("BSD-2-Clause", "1cd2d4d633195ae0e7223a94a138f2ffeb48b5c1e6cbc2bd997dfae4cd96abd6"),
    ("BSD-2-Clause", "1e519f8916dca74c89371617f4339d40a4ed3bb71e801c14aa72e8071bafaf81"),
    ("BSD-2-Clause", "239190ee903aca2851ccd5099cd7954d026d60f9b9f98e391ca652499c6aaae1"),
    ("BSD-2-Clause", "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-2-Clause", "2c570d136b858b0a4d090e301862eacb53fb1ae2743462bf3b89e602191665f7"),
    ("BSD-2-Clause", "2e9901df2d3cdd9b2ad2d0541a98d0ffe16ec6a54494b7837b493c08b3bde071"),
    ("BSD-2-Clause", "33903615089fdb3ab02696d1bd92eb9580c2c7a0e0c8714aa95b0dfc1dcdb89c"),
    ("BSD-2-Clause", "3938f828c79910468f483f925e6a33217162693f71035d6044cbd04dc6fd1bd5"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "4a5b45ed3ca9ae854c5505a774b3659d3852be9a3412b822802b3cdbe5dc7b0a"),
    ("BSD-2-Clause", "4b12427c919036fc08e3d3d6bda2d2d0fed58212d4c5dfc57237af4a66887098"),
    ("BSD-2-Clause", "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374"),
    ("BSD-2-Clause", "5d123f3d2076a6b22f7b17a92623627ef50d1584e8cf13b7d4040f1c6e8a0424"),
    ("BSD-2-Clause", "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9"),
    ("BSD-2-Clause", "712dce7d673ff7e1550976bfd879c441ad93a2d9906c3c4ae27441d29fa3350b"),
    ("BSD-2-Clause", "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-2-Clause", "85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221"),
    ("BSD-2-Clause", "8b28f63734bf310903015ecd26ae5c979f31743ca170703b95426d7203774453"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "b02d799e391838a73a0ccc75692ba88eafccab18abbd5f907e855d22048655d4"),
    ("BSD-2-Clause", "b5335fc56cb06fb488859427303188fdccfe901752d74938dbb3e63c952746a4"),
    ("BSD-2-Clause", "b7d49d651647319f38c254df78d020e1c773cbac121d97b17eb70bf3149e7233"),
    ("BSD-2-Clause", "c5cb44b340dfa97436d18371e401686dddf3451388afa1a24c0e410cd7a38b24"),
    ("BSD-2-Clause", "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9"),
    ("BSD-2-Clause", "f660a20fd170fe8b6282213c3411227a553f1451ee95bd49ed6ca3abe7045314"),
    ("BSD-2-Clause", "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b"),
    ("BSD-3-Clause", "02cbb88221e507a296bab4438d8c41fc55a45c1e486982b72971ef667bab440e"),
    ("BSD-3-Clause", "08736309e21ef4f4f04fe8d65d940170f6dead365ae956175f9f925b68835df1"),
    ("BSD-3-Clause", "0d9569accbee32dd3a420896d10f915d23071d627b49ca2f194661b3fa6aa139"),
    ("BSD-3-Clause", "0fbd7c43c4bb3e398d262b8e39f58ee0a8709a2b3b6b4bee4e033b3d5755f58d"),
    ("BSD-3-Clause", "10c89c9e62f2b6c947ea137f0e621f0a633a2b97ff8969d9287edd3355157916"),
    ("BSD-3-Clause", "1157d7738c8e4b9714da26c13a27d402141a7cfc68c80f72c30fe25698134732"),
    ("BSD-3-Clause", "13bd4956c077751ad193b5da48b859c64ed6922c7c2b69a588be360696d979c1"),
    ("BSD-3-Clause", "17315dbc6c309787bcb7c706980cc71df3a769df14c28c564ebd7dc87cea833d"),
    ("BSD-3-Clause", "19a4781693c27171941c3997100df63b3707e99f2135091c98fb3aba3429a921"),
    ("BSD-3-Clause", "1cb774cab06cb9b7b6bc35f61dfc1901473cb3a0bcab3e045bc6f74c3e8fd4eb"),
    ("BSD-3-Clause", "1de857b024170679904cc5312e3c0ba9745a155d5302a47b7affb0d2913c9dea"),
    ("BSD-3-Clause", "1df9653bc861bd2d04debc888c7520b12f8069da758fe64b63338ed87412a59f"),
    ("BSD-3-Clause", "1ea725e6572a22de6d4653fa21824d67cb8adf234fcd3807dbfb86b8715b3511"),
    ("BSD-3-Clause", "214aa9c28152d6d77e6bebfb4a7511e677f65fdaf94b0fe9c0bb580e0eaf8997"),
    ("BSD-3-Clause", "2197427e156dd704210ae726a3807f7deae35bc31d7243168c575348f6a5419b"),
    ("BSD-3-Clause", "27a2e1e89e7112620faea164ab107b2aa62736c29f8447674a19f27a4b44d972"),
    ("BSD-3-Clause", "2862502b8c0b9e2898bddc193550da25efbe12dcc633cf5c250c8acd75d2fcfc"),
    ("BSD-3-Clause", "2a4386d4ecdb97d143f06b73903fc9ff8f6c02d18e34a454e12468669d45c531"),
    ("BSD-3-Clause", "2c68b67886ccd0f6091bfb3b3a840083bda8889d6af0ee4c3bed709d9ee932e9"),
    ("BSD-3-Clause", "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903"),
    ("BSD-3-Clause", "328a31843f58a876c6ead2604a5041aeb2e007af6d7f19ae771aeaa813d47b88"),
    ("BSD-3-Clause", "334239264ef811f8c689bbf963dc1324d2da10b588bf2be3d8d44b93626fa39c"),
    ("BSD-3-Clause", "3558940b39dab78a471fb340f6a46d9c8ab5a19df8f738e5c348b2d5f130d23d"),
    ("BSD-3-Clause", "381a1597c60970e78836bb7d9da99e690f5a6664751fe19cd5447f6bce238970"),
    ("BSD-3-Clause", "3b4db0a6e1494960911161a55ef4bc0b878d7d58c280e2e16f189d63a8ca667b"),
    ("BSD-3-Clause", "3f40d30c80cd890ab1934322d28e43e97fc9b9036b82cb2afd81384fcb3dc29d"),
    ("BSD-3-Clause", "4241a91ed59fdc8d1c20d065984925429610744add02cce3becf94e4e83c49f9"),
    ("BSD-3-Clause", "439b47ad2badc685d1f839d73c108dd2fc0f485a8fa1d8f722dc90570de9a0a9"),
    ("BSD-3-Clause", "44d5f2122976da667c376147638bbb5901091365c00f6f5710982f5b3f67d59c"),
    ("BSD-3-Clause", "4898509c3929c3aa032c13508986410d68ff1db07ca435c3de97b8ec26266df8"),
    ("BSD-3-Clause", "496a88fb77f7cf55994de8bd2b87ac0e9302e2dc1b11f567dd0447f8f0648ab1"),
    ("BSD-3-Clause", "4a28e38c08b92fc6bdaa30147f25eefad1c4645e38a5d0f1bad6f462a55c6200"),
    ("BSD-3-Clause", "4af3efd27cc12d2146661de254afc90bde9fc2c708eddbfe69013f2c8cf24654"),
    ("BSD-3-Clause", "4d4c7991eec13c8481fd08902fee35e8a6cb959c727b7aa5dc0c4ce6bbb9c6a3"),
    ("BSD-3-Clause", "4fec7901c0764f1c632da504aa28d5de5e7e5f0783c88d1e3fd21de4f97e315d"),
    ("BSD-3-Clause", "52708ae7496bad323efc341f2b977f4deecc250729644235974381dbffa10b45"),
    ("BSD-3-Clause", "52c8e1f1387429e4ac2e46a159e2b2d17320de20b05dce03cbd7a7cf9be73702"),
    ("BSD-3-Clause", "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", "54a11abe42208b3ea52a7682e9597e365d3170c949afe123c4a0ea6fd698cfe1"),
    ("BSD-3-Clause", "55f86b555a628a29b6625f8951850429f117f7483c94eb44deef54ea9d5add2b"),
    ("BSD-3-Clause", "5a4a8574c9001b24cbf954f8ff152e19d697fe266309343060d8badd306361a7"),
    ("BSD-3-Clause", "5a6e7ec0b1ac1e224277a8a6d5cd7691ea38298b0308b87a7a2e539d020ed1e0"),
    ("BSD-3-Clause", "63af53fd1fbf09af6ac254fa47b5e7a58be0108be793d5b3a7cea78be0afda1a"),
    ("BSD-3-Clause", "6471473b7ed7e798261ec5291292f01ff34fa65af36d81fb499a6b2d192adb65"),
    ("BSD-3-Clause", "69083549410d2f63af7724cabe9383c3da756a9875b71a13bdf06f218d41d7cc"),
    ("BSD-3-Clause", "6a794051fca3bb53638164340f6c2263e652d548fea0d01b009536b223272ba1"),
    ("BSD-3-Clause", "6b447d18d19d7da8f98936feff9dc12a238d4fb355080af57e56d70f31155dcb"),
    ("BSD-3-Clause", "6cded2d64ede823606e0ad912d43ef7cf641160926310fa31217c3749fa32aee"),
    ("BSD-3-Clause", "6f922c6cb2a22faa1c3d9be59103bf5dc2942321f1c76cc3b6f0772aa184826c"),
    ("BSD-3-Clause", "6fe598122e1aa2b70062c6f47fe24bc861d8d7933b9783fff19b948b714e4487"),
    ("BSD-3-Clause", "70f92f35862f27c95a390cf57675d409d26cad237a81d89d1e4fd53bb8588730"),
    ("BSD-3-Clause", "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da"),
    ("BSD-3-Clause", "748321defc17decd4d7c5f064a98f5c766a66aeec2b05356ee253d10062349a7"),
    ("BSD-3-Clause", "7668aff13b074ee8ff72fe4d1e7a5866b755b8fc00cd0239e4e80aec12f32127"),
    ("BSD-3-Clause", "7bb2a58f1a2613692218c36c4b52e004c6b230ce814c88d01ee7692bc36b3431"),
    ("BSD-3-Clause", "7c16b387b2fd67aea7403110df9457eea9844b938eda62df5f98a56797001ccf"),
    ("BSD-3-Clause", "7ff930ea71849aaf0c835ceb1878a1b5701718486309c5d8319d01a8a2bbf8ac"),
    ("BSD-3-Clause", "8078ca96ff592b24ba127e14c7f110f54057dcde2c6023deb34983ec3e23196c"),
    ("BSD-3-Clause", "811a0d4ebb0ce780830114843f58a41dc74ad52ee6ac72f61b9ac6789b30b074"),
    ("BSD-3-Clause", "822589365a482927ed17e01772f75beb89b8f814727a95e47a6d015923356736"),
    ("BSD-3-Clause", "845ba3fce0ead2e85d28b60637f5fb13855d17a9671b18a047ea752007aba012"),
    ("BSD-3-Clause", "84c781b5d7e3445d472ea78f86da8ce1f7cf3f8a699eed9e76e2fde2284fa9b6"),
    ("BSD-3-Clause", "85a253fdca75357d8f16143d242204d0c291650df54bf470a94c229f0d848c65"),
    ("BSD-3-Clause", "8a69b3ae3c37b6cf9ce330b5e5e3050e29100621d05ba8c828ff817e2e6556ef"),
    ("BSD-3-Clause", "8ade638323b06be3951b2c6a8ac27489a02d9bce0b9baa223586a0136cc01098"),
    ("BSD-3-Clause", "8c522fd0ac9d7a67d2a169d7b259fff40224dd0e66ab466ff7112dc6b6c6a0de"),
    ("BSD-3-Clause", "8daafb52633012c89cb7d69b91cb803859fb5cd5020eecaf429b992ee55f23ce"),
    ("BSD-3-Clause", "8ec96ac102a1a4e8a51586c5069c7bbf5b233cd4fd6c2e01ef2e376f9fbace63"),
    ("BSD-3-Clause", "912a9ee21e203f7f4fadb3c13100e62bfed142edd4b67fa4672c4d62df0ffa5b"),
    ("BSD-3-Clause", "94a0a44b170114affb7b3975c6987906dca819b6cbd93510aa70be57345a1e3f"),
    ("BSD-3-Clause", "9a555874297cc48b4c505e59638326e6e9341fb0af3c199af45433b2f33717f0"),
    ("BSD-3-Clause", "9ac2a8d687f8f027199caeb75375c6df77a9682afac572cb60e9731941c458f2"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "9b9ac51f5ca1f4f99ccf94a0770c77723a9b4a5eaf09e0de3f8c9ec65b1f396d"),
    ("BSD-3-Clause", "9c07b35bff4c7723f05498d5016671e6aab167812efed57d22d711c2877f486b"),
    ("BSD-3-Clause", "a14a2f9c34cdf89b7a54ad8a079178aae9a317447ea94fb94a41f6b9a421bc79"),
    ("BSD-3-Clause", "a196d630887c3a343519ccd5e202cc4617ac5f655e4a52ae5116272f816d6073"),
    ("BSD-3-Clause", "a1b219564f74c286b8e6d513ce628a398682d68f7ebee4316d742d704938f7dd"),
    ("BSD-3-Clause", "a65aa119a9ae25139c00daa069f0ba1397cbaf52bc0cb15bce536c93c866827a"),
    ("BSD-3-Clause", "b5d5d48337502fcd6670c00ce4f7072a903d7b9535f1ce16443303c3349c8760"),
    ("BSD-3-Clause", "b6ab7953b6c80a72261014244324a70663f1807fa212f52461b24c95eb16b4a9"),
    ("BSD-3-Clause", "bb17d1e78bbbe62ff8673ad110ea7261693b72f37d93bc54bebe3cb205e66ca8"),
    ("BSD-3-Clause", "bb9673c5222873ae20b44ed8adee0126945a8168f2e943b5cf751ffd142f5f76"),
    ("BSD-3-Clause", "bd7d910c4d2db198970b03aa0712c2453834c2245727445d4d1552208efbd9be"),
    ("BSD-3-Clause", "c19e45e4caf36d04a07032e4291ae19dfa1ba7a438b4d073c576d8271eb7dbd1"),
    ("BSD-3-Clause", "c3c37a3f2460d1e6b986324f6532d2e7c13d17671d91e5ccbf8b24d2caa2a3db"),
    ("BSD-3-Clause", "c40e1b17ae4c0807286fe53911e6e6f4f9c179932585ed71938b78004a0ff14c"),
    ("BSD-3-Clause", "c6b05108697229cffa4c3c4234c0eb8a75b86267fcaa8a540f077630d96fd010"),
    ("BSD-3-Clause", "c86d75bd19f935ac6c644509e3159cdd3a6b0519968c41dc09d8aa09542a9ffa"),
    ("BSD-3-Clause", "c923f0176bf43797c3b86a4a75851a9ea679c9901d7d88632e82b59903e8c632"),
    ("BSD-3-Clause", "cc3432eb2f19bb6fe96706bad75b6fce1039db64fb70486899bf6425dea4d9cb"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "ce5768c5a2c437eafe95d0560368dc27af077dc008c1f779e3b063b77f2d77c2"),
    ("BSD-3-Clause", "ceb36b0173297578925e297a5e163a7f0f988327f28c8eb9654153d4354b2598"),
    ("BSD-3-Clause", "ceb539a14a135648f303dbe38b2f990c43786bd70c95bbbfa427010d5444ec1f"),
    ("BSD-3-Clause", "d3b3be4ec9c5c0af1c71fe9ec8d978dd5e0d478105b6276ecb2bcadc9fa4b707"),
    ("BSD-3-Clause", "d4542b2c750ddc48ef799c19992beedb965469683f3ad3c4ecfee120fcf832c5"),
    ("BSD-3-Clause", "d6257db4781e8531fee85c1cd8fe8adf06a6b7763ed73da1906a14d24925fc1d"),
    ("BSD-3-Clause", "d71b26459af241c9e1dfd46f88409f2f7b7747d3f0263d13b23f41dc4deb0f84"),
    ("BSD-3-Clause", "d82109ca031904db888330a0ab8c8987685e71f8dbff7393792df6d32b4ae712"),
    ("BSD-3-Clause", "d8e6c805d983d78be03b040fd27b637d000d749ef8133d58acb67d17c14cbf2f"),
    ("BSD-3-Clause", "d99bc901b1802af0bd898a6327beafccc15295abc9cd9b7a37f66461ac940a7c"),
    ("BSD-3-Clause", "dbdfde7fe53358e4d135fcf0485ffc425b2b94f13f57afa9728bfb29ad9c40e5"),
    ("BSD-3-Clause", "dc06088169d82bfb3bf20fa94566038849b41f0c772ebdf6cc13a92263873a65"),
    ("BSD-3-Clause", "dc4d5134c964e004931f093e62245e46181f326f13bb71cd54b9555b835fe7b4"),
    ("BSD-3-Clause", "dd9c572087f92a74232343008a70468eeee08d97112450db549eb0fb33a8d29e"),
    ("BSD-3-Clause", "de4c90d2c37524af7fcd7ba71dd26116127061387ebb8942c3790d502e4889f0"),
    ("BSD-3-Clause", "df3b193a4f85c590037080c30f47cfcdbf25233523cdbb8afd225ef7b9556ec3"),
    ("BSD-3-Clause", "e16232133565da1c02ccbe6ab1aa386e795270c664550bcb1e462f4e31ad5ae6"),
    ("BSD-3-Clause", "e1c77bcf6c0f4690e88ee18bd465d8d09160c87ff84b4e55a8bcaf74cb1267f7"),
    ("BSD-3-Clause", "e60143686f94bbff438ca8d1ec28b93f48dab068c458d943110c425586e89f38"),
    ("BSD-3-Clause", "e612af111b0f62aac3e107973cd804ade8a118ba3c7034d6824ebdce9852ba2e"),
    ("BSD-3-Clause", "e651765ec94c99c2ea03cf19aceb85785d656ba08685eb0772747c296340cb54"),
    ("BSD-3-Clause", "e660e4f62461ca04698fe7a71acfbf6e8d399f91c966099adc619d9c0b0671d9"),
    ("BSD-3-Clause", "e6c6ae9594f5eac0613ead2cd2176cf91f031c98c454f7b42103ce0d65bc40ce"),
    ("BSD-3-Clause", "e989b2fa4a8515f8b29a0f0274aac18a81c6b26b8de0b98c8fdec021c03e34fd"),
    ("BSD-3-Clause", "ebdea9b587b934d0ec46f02c5f7088f957b8c701b754cccae6e7a985f1e65819"),
    ("BSD-3-Clause", "ef8ac24af610d366eb6782dc350def12860ed20c0ccb8441d3fd0d3899373ed7"),
    ("BSD-3-Clause", "f0e34c755ce79f8a84e429d2c181826fb18623b042199acf383e29a99c467d4f"),
    ("BSD-3-Clause", "f5e8212bdbf0465a5196123ad9b72a89f88bba7071a03c91b20f6ca41def6fd6"),
    ("BSD-3-Clause", "f797d8bcfec14f42f9eb6fe202623e1ffcbe267e5f375ebc41152fa6035935fd"),
    ("BSD-3-Clause", "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("BSD-3-Clause", "fa8eee52cef33c5c1c90a2d4abcc1967d0decd02989a8714e04c9bfeaca3cb29"),
    ("BSD-3-Clause", "fcbbf81dc459cbe67fe6ae0da1edb9cbb5e1b0d59f1ff0cc2d084d2c9545b0c7"),
    ("BSD-3-Clause", "fcfaca9856c9d06723391332be070f14157dc455699d40c8852a50b70f45fada"),
    ("BSD-3-Clause", "fd690ba616f1a75c69b173d958d3840f12e0ac0e59ecc828f93a4961e07ff5e4"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1"),
    ("ISC", "280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29"),
    ("ISC", "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("ISC", "673f59dc8ad54524704b5b5d2deeb39eec917afad46597b1b7d4f2963edff317"),
    ("ISC", "8281b7122b87e54b97a6183786fef9b33350db9bfb9141855ea93e09543e1fcc"),
    ("ISC", "8ee0d4f927294d5cfe44a2a4b1faecb347cc94d0e53edd910b1abc0f6527865f"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688"),
    ("LGPL-2.0", "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f"),
    ("LGPL-3.0", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MIT", "7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4"),
    ("MPL-2.0", "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7"),
    ("MPL-2.0", "c7625b8590f2bd72af25ea48c9d735f0b781eb75cc74e8419c28c89cb57a87fb"),
    ("Unlicense", "8d3909f4543649cfba0b0b1fc765c67acf3736106a78237ea2972f83eaa7dd3e"),
    ("Unlicense", "e0a799e7d185f19d7fdcb7cb051a4177ef6512052fc563b932e65ca1e5805e14"),
    ("WTFPL", "5757ac9cdd42713ed24f9dc174585ad1f3d214a70f8b5a6bc83ea39768bbe195"),
    ("WTFPL", "87ec3b91b91006af7a5cb541ea76c2ad58276dc60029db018d7692bb0febfc11"),
    ("WTFPL", "a9f26b707eeeb4f283af763733744ef1082c9b86fd7e5e8c65bcd4dde8927be0"),
    ("WTFPL", "e1bacb566dfb2e5287487be7047cc0f617944e065806ad5fc5b5456d875a5cab"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
    ("Zlib", "ee37bc3ccba61ff28a10c05f28bdabf7466db400a75d9a1890fb865cda23e145"),
)
