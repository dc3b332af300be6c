"""The domain registry: ordered domains with core and support terms, as a parameter.

A registry is a JSON object {"domains": {name: {"core": [...], "support": [...], "support_only_min": n}},
"aliases": {old name: name}}. The sample serves the queries over the test tables; a real one is read with load().
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    name: str
    core: tuple[str, ...]
    support: tuple[str, ...]
    support_only_min: int | None = None


@dataclass(frozen=True)
class Registry:
    domains: tuple[Domain, ...]
    aliases: dict = field(default_factory=dict)

    def __post_init__(self):
        """A registry has domains with different names, each with core terms and no repeated term in a list."""
        names = [d.name for d in self.domains]
        if not names or len(set(names)) != len(names):
            raise ValueError("domain names must be different and not none")
        for d in self.domains:
            if not d.core or len(set(d.core)) != len(d.core) or len(set(d.support)) != len(d.support):
                raise ValueError(f"terms of {d.name}: core must not be empty, no list may repeat a term")
            if any(not t.strip() for t in (*d.core, *d.support)):
                raise ValueError(f"{d.name} has a blank term")
        if unknown := set(self.aliases.values()) - set(names):
            raise ValueError(f"aliases of unknown domains: {sorted(unknown)}")

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.domains]

    def terms(self) -> list[tuple[str, int, str, int, str]]:
        """(domain, its place, kind, place of the term in its kind, term); core before support."""
        return [(d.name, i, kind, j, t) for i, d in enumerate(self.domains) for kind, list_ in (("core", d.core), ("support", d.support)) for j, t in enumerate(list_)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The terms as a table; its size is that of the registry, not of the data."""
        return spark.createDataFrame(self.terms(), "domain string, ord int, kind string, term_ord int, term string")

    def canonical(self, name: Column) -> Column:
        """A domain's present name for its name or an alias; null for anything else. Blanks around it don't count."""
        t = F.trim(name)
        out = F.when(t.isin(self.names), t)
        for old, new in self.aliases.items():
            out = out.when(t == old, new)
        return out

    def fingerprint(self, version: int) -> str:
        """Stable hash of the registry's terms and the version of the rules."""
        payload = {"version": version, "profiles": {d.name: {"core": d.core, "support": d.support, "support_only_min": d.support_only_min} for d in self.domains}}
        return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load(payload: str | dict) -> Registry:
    """A registry from JSON text or an object of the same form."""
    data = json.loads(payload) if isinstance(payload, str) else payload
    domains = tuple(Domain(name, tuple(p["core"]), tuple(p.get("support", ())), p.get("support_only_min")) for name, p in data["domains"].items())
    return Registry(domains, dict(data.get("aliases", {})))


#: For the queries over the test tables: a few terms of each of their subjects.
SAMPLE = load(
    {
        "domains": {
            "AI": {"core": ["大模型", "智能体", "知识蒸馏", "language model", "fine-tuning", "embedding"], "support": ["提示词", "微调", "benchmark leak", "token budget"], "support_only_min": 4},
            "Quant": {"core": ["回测", "因子", "滑点", "backtest", "slippage"], "support": ["基差", "换手率", "drawdown", "order book"]},
            "信息技术": {"core": ["微服务", "编译器", "缓存穿透", "compiler pass", "message queue"], "support": ["线程池", "日志采集", "thread pool", "code review"]},
            "投资理财": {"core": ["基金", "房贷", "债券", "mortgage", "dividend"], "support": ["汇率", "保险", "cash flow", "exchange rate"]},
            "知识管理": {"core": ["知识库", "卡片笔记", "双向链接", "card note", "second brain"], "support": ["剪藏", "元数据", "web clipping", "tag system"]},
            "健康医学": {"core": ["疫苗", "血压", "睡眠", "vaccine", "blood pressure"], "support": ["过敏", "体检", "allergy", "sleep cycle"]},
            "中医": {"core": ["针灸", "气血", "黄芪", "acupoint", "meridian"], "support": ["脾胃", "艾灸", "cupping", "gua sha"]},
            "两性情感": {"core": ["婚姻", "恋爱", "marriage", "breakup"], "support": ["相亲", "求婚", "jealousy", "anniversary"]},
            "个人成长": {"core": ["时间管理", "自律", "习惯养成", "habit streak", "procrastination"], "support": ["早起", "复盘", "weekly retro", "mentor"]},
            "科技产业": {"core": ["芯片", "光刻机", "动力电池", "chip maker", "wafer fab"], "support": ["产能", "良率", "rare earth", "supply chain"]},
            "自然科学": {"core": ["量子纠缠", "细胞分裂", "概率论", "quantum state", "cell division"], "support": ["火山", "洋流", "entropy", "volcano"]},
            "文史社政": {"core": ["科举", "漕运", "书院", "imperial exam", "canal transport"], "support": ["碑刻", "考据", "election", "old academy"]},
        },
        "aliases": {"软件工程": "信息技术", "历史与社会": "文史社政"},
    }
)
