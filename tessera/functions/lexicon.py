"""Segmentation dictionaries: a Chinese word list, and Japanese and Hangul lexicons."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: A small Chinese word list with rough frequencies; callers pass their own.
CHINESE = {
    word: 1000.0 / (1 + k // 20)
    for k, word in enumerate(
        "我们 你们 他们 中国 世界 你好 北京 上海 重庆 天津 广州 深圳 大学 北京大学 清华大学 学生 老师 火锅 方案 内存 全球 供应 短缺 之际 退出 消费 业务 "
        "公司 企业 市场 经济 发展 技术 科学 研究 工作 问题 时间 时候 今天 明天 昨天 现在 已经 可以 因为 所以 但是 如果 没有 什么 怎么 为什么 这个 那个 "
        "一个 一些 自己 大家 朋友 国家 政府 社会 人民 文化 历史 教育 学校 医院 医生 健康 生活 家庭 孩子 父母 电影 音乐 新闻 报道 记者 网络 互联网 手机 "
        "电脑 计算机 软件 硬件 数据 数据库 搜索 引擎 搜索引擎 索引 系统 程序 程序员 开发 设计 产品 服务 客户 用户 管理 项目 计划 会议 报告 文件 信息 "
        "语言 中文 英文 汉字 拼音 测试 文档 文本 东京 日本 美国 英国 法国 德国 人工 智能 人工智能 机器 学习 机器学习 模型 训练 语料".split()
    )
}


@dataclass
class ScriptDictionary:
    entries: set[str] = field(default_factory=set)
    version: str | None = None


@dataclass
class DictionaryConfig:
    """Lexicons for kana (Hiragana, Katakana) and Hangul runs."""

    japanese: ScriptDictionary | None = None
    hangul: ScriptDictionary | None = None

    def entries_for(self, script: str) -> set[str]:
        chosen = {"hiragana": self.japanese, "katakana": self.japanese, "hangul": self.hangul}.get(script)
        return chosen.entries if chosen else set()


def longest_matches(run: str, entries: set[str]) -> list[tuple[int, int]]:
    """Greedy forward longest matches, as (start, end) in characters."""
    longest = max(map(len, entries), default=0)
    found, at = [], 0
    while at < len(run):
        for size in range(min(longest, len(run) - at), 0, -1):
            if run[at : at + size] in entries:
                found.append((at, at + size))
                at += size
                break
        else:
            at += 1
    return found


def best_path(run: str, words: dict[str, float]) -> list[tuple[int, int]]:
    """The most probable cut of a Chinese run in words; unknown characters stand alone."""
    longest = max(map(len, words), default=1)
    log_total = math.log(sum(words.values()) or 1.0)
    best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
    for at in range(len(run) - 1, -1, -1):
        options = []
        for end in range(at + 1, min(len(run), at + longest) + 1):
            weight = words.get(run[at:end])
            if weight is not None or end == at + 1:
                options.append((math.log(weight or 1.0) - log_total + best[end][0], end))
        best[at] = max(options)
    out, at = [], 0
    while at < len(run):
        out.append((at, best[at][1]))
        at = best[at][1]
    return out


def search_words(run: str, words: dict[str, float]) -> list[tuple[int, int]]:
    """``best_path``, each long word led by the listed words of two and three characters in it."""
    out = []
    for start, end in best_path(run, words):
        for size in (2, 3):
            if end - start > size:
                out += [(k, k + size) for k in range(start, end - size + 1) if run[k : k + size] in words]
        out.append((start, end))
    return out
