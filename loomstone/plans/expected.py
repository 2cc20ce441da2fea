"""What license texts say, in SQL of its own, so that a wrong list in the rules shows.

Both take the lower-cased text as ``t``.
"""

# Texts and labels of licenses.
LICENSE_SQL = """CASE
WHEN contains(t, 'pmc open access subset') AND (contains(t, 'world health organization (who) declaration of covid-19 as a global pandemic') OR contains(t, 'duration of the covid-19 pandemic') OR contains(t, 'until permissions are revoked in writing')) THEN 'PMC_OPEN_ACCESS_TEMP'
WHEN contains(t, 'creativecommons.org/licenses/by-nc-nd/4.0') OR contains(t, 'cc by-nc-nd 4.0') OR contains(t, 'creative commons attribution-noncommercial-noderivs 4.0') OR contains(t, 'creative commons attribution-noncommercial-no derivatives 4.0') THEN 'CC_BY_NC_ND_4_0'
WHEN contains(t, 'creativecommons.org/licenses/by-nc-sa/4.0') OR contains(t, 'cc by-nc-sa 4.0') OR contains(t, 'creative commons attribution-noncommercial-sharealike 4.0') THEN 'CC_BY_NC_SA_4_0'
WHEN contains(t, 'creativecommons.org/licenses/by-nd/4.0') OR contains(t, 'cc by-nd 4.0') OR contains(t, 'creative commons attribution-noderivs 4.0') OR contains(t, 'creative commons attribution-no derivatives 4.0') THEN 'CC_BY_ND_4_0'
WHEN contains(t, 'creativecommons.org/licenses/by-sa/4.0') OR contains(t, 'cc by-sa 4.0') OR contains(t, 'creative commons attribution-sharealike 4.0') THEN 'CC_BY_SA_4_0'
WHEN contains(t, 'creativecommons.org/licenses/by-nc/4.0') OR contains(t, 'cc by-nc 4.0') OR contains(t, 'creative commons attribution-noncommercial 4.0') THEN 'CC_BY_NC_4_0'
WHEN contains(t, 'creativecommons.org/licenses/by/4.0') OR contains(t, 'cc by 4.0') OR contains(t, 'cc-by 4.0') OR contains(t, 'creative commons attribution 4.0') OR contains(t, 'licensed under a creative commons attribution 4.0 international license') OR contains(t, 'creative commons attribution license (cc by)') THEN 'CC_BY_4_0'
WHEN contains(t, 'creativecommons.org/licenses/by-nc-nd/3.0') OR contains(t, 'cc by-nc-nd 3.0') THEN 'CC_BY_NC_ND_3_0'
WHEN contains(t, 'creativecommons.org/licenses/by-nc-sa/3.0') OR contains(t, 'cc by-nc-sa 3.0') THEN 'CC_BY_NC_SA_3_0'
WHEN contains(t, 'creativecommons.org/licenses/by-nd/3.0') OR contains(t, 'cc by-nd 3.0') THEN 'CC_BY_ND_3_0'
WHEN contains(t, 'creativecommons.org/licenses/by-sa/3.0') OR contains(t, 'cc by-sa 3.0') THEN 'CC_BY_SA_3_0'
WHEN contains(t, 'creativecommons.org/licenses/by-nc/3.0') OR contains(t, 'cc by-nc 3.0') THEN 'CC_BY_NC_3_0'
WHEN contains(t, 'creativecommons.org/licenses/by/3.0') OR contains(t, 'cc by 3.0') OR contains(t, 'cc-by 3.0') THEN 'CC_BY_3_0'
WHEN contains(t, 'creativecommons.org/licenses/by/2.0') OR contains(t, 'cc by 2.0') OR contains(t, 'cc-by 2.0') THEN 'CC_BY_2_0'
WHEN contains(t, 'creativecommons.org/licenses/by-nc-sa/1.0') OR contains(t, 'cc by-nc-sa 1.0') OR contains(t, 'cc-by-nc-sa 1.0') THEN 'CC_BY_NC_SA_1_0'
WHEN contains(t, 'creativecommons.org/publicdomain/mark/1.0') THEN 'PUBLIC_DOMAIN_MARK_1_0'
WHEN contains(t, 'creativecommons.org/publicdomain/zero/1.0') OR contains(t, 'cc0 1.0') OR contains(t, 'creative commons public domain dedication waiver') THEN 'CC0_1_0'
WHEN contains(t, 'creative commons') THEN 'CREATIVE_COMMONS_UNCLEAR'
WHEN contains(t, 'open access') THEN 'OPEN_ACCESS_UNCLEAR' ELSE 'UNKNOWN' END"""

# How texts write a license's version, in the order in which they count.
VERSION_SQL = r"""coalesce(CASE WHEN regexp_extract(t, 'creativecommons\.org/licenses/by-nc-nd/(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creativecommons\.org/licenses/by-nc-nd/(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creativecommons\.org/licenses/by-nc-sa/(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creativecommons\.org/licenses/by-nc-sa/(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creativecommons\.org/licenses/by-nc/(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creativecommons\.org/licenses/by-nc/(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creativecommons\.org/licenses/by-nd/(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creativecommons\.org/licenses/by-nd/(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creativecommons\.org/licenses/by-sa/(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creativecommons\.org/licenses/by-sa/(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creativecommons\.org/licenses/by/(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creativecommons\.org/licenses/by/(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, '\bcc[- ]by[- ]nc[- ]nd\s+(\d\.\d)\b', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, '\bcc[- ]by[- ]nc[- ]nd\s+(\d\.\d)\b', 1) END,
CASE WHEN regexp_extract(t, '\bcc[- ]by[- ]nc[- ]sa\s+(\d\.\d)\b', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, '\bcc[- ]by[- ]nc[- ]sa\s+(\d\.\d)\b', 1) END,
CASE WHEN regexp_extract(t, '\bcc[- ]by[- ]nc\s+(\d\.\d)\b', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, '\bcc[- ]by[- ]nc\s+(\d\.\d)\b', 1) END,
CASE WHEN regexp_extract(t, '\bcc[- ]by[- ]nd\s+(\d\.\d)\b', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, '\bcc[- ]by[- ]nd\s+(\d\.\d)\b', 1) END,
CASE WHEN regexp_extract(t, '\bcc[- ]by[- ]sa\s+(\d\.\d)\b', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, '\bcc[- ]by[- ]sa\s+(\d\.\d)\b', 1) END,
CASE WHEN regexp_extract(t, '\bcc[- ]by\s+(\d\.\d)\b', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, '\bcc[- ]by\s+(\d\.\d)\b', 1) END,
CASE WHEN regexp_extract(t, 'creative commons attribution-noncommercial-noderivs\s+(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creative commons attribution-noncommercial-noderivs\s+(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creative commons attribution-noncommercial-no derivatives\s+(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creative commons attribution-noncommercial-no derivatives\s+(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creative commons attribution-noncommercial-sharealike\s+(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creative commons attribution-noncommercial-sharealike\s+(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creative commons attribution-noncommercial\s+(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creative commons attribution-noncommercial\s+(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creative commons attribution-no derivatives\s+(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creative commons attribution-no derivatives\s+(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creative commons attribution-noderivs\s+(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creative commons attribution-noderivs\s+(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creative commons attribution-sharealike\s+(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creative commons attribution-sharealike\s+(\d\.\d)', 1) END,
CASE WHEN regexp_extract(t, 'creative commons attribution\s+(\d\.\d)', 1) IN ('1.0', '2.0', '2.5', '3.0', '4.0') THEN regexp_extract(t, 'creative commons attribution\s+(\d\.\d)', 1) END)"""
