"""Word lists of the search and ranking rules, as values and as small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------
SYNONYM_GROUPS = (
    ("채용", "모집", "공고"),
    ("인턴", "intern", "인턴십"),
    ("상담", "컨설팅", "컨설팅룸", "상담예약"),
    ("취업프로그램", "직무부트캠프", "프로그램"),
    ("자기소개서", "자소서", "첨삭"),
    ("가이드북", "매뉴얼", "사용자가이드"),
    ("취업준비도검사", "진로적성검사", "진로설계", "경력개발", "포트폴리오"),
    ("취업성공후기", "선배", "사례", "인터뷰"),
    ("컴퓨터공학", "컴퓨터공학과", "컴공", "컴퓨터학부", "소프트웨어", "개발자"),
    ("활동", "대외활동", "프로젝트", "포트폴리오", "취업프로그램", "직무부트캠프", "인턴", "현장실습"),
)
LISTING_TERMS = ("채용", "모집", "공고", "인턴", "intern", "인턴십", "현장실습", "아르바이트")
FILLER_TERMS = (
    "난", "내", "뭔", "지금", "위해", "하면", "좋을", "좋을까", "하려고", "하려고해", "쪽으", "쪽으로", "으로", "못", "려줘", "알려", "알려줘",
)
NOISE_SIGNALS = (
    "포털시스템 로그인", "아이디/비밀번호", "공유", "인쇄", "다운로드", "전체화면", "PRINT", "목차", "MAIN", "HOME", "exit_to_app", "subjectclose",
)
ANSWER_SIGNALS = (
    "상담예약", "전문가 상담", "컨설팅룸예약", "취업프로그램", "채용정보", "자기소개서 첨삭", "교수님 상담", "진로설계", "경력개발",
    "경력포트폴리오", "포트폴리오", "취업준비도검사", "직무부트캠프", "현장실습", "인턴채용", "일반채용", "아르바이트", "가이드북", "취업성공후기",
)
# ----------------------------------------------------------------------------


def synonym_pairs(groups: Sequence[Sequence[str]] = SYNONYM_GROUPS) -> list[tuple[str, str]]:
    """(term, synonym) rows; a term of several groups belongs to the last one (O-26)."""
    home = {term: group for group in groups for term in group}
    return [(term, other) for term, group in home.items() for other in group if other != term]


def synonym_table(spark: SparkSession, groups: Sequence[Sequence[str]] = SYNONYM_GROUPS) -> DataFrame:
    return spark.createDataFrame(synonym_pairs(groups), "term string, synonym string")
