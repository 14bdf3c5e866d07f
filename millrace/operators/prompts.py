"""Prompts of chat models: one renderer over a table of separator styles, named templates, and few-shot chats.

A conversation is an array of (role, text); a turn without text is the one that the model is to fill in.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Style:
    """How a style joins a conversation.

    ``head``: what stands before the turns, with {system} (the filled system template), {message} (the bare system message),
    {sep} and {sep2}. ``if_any`` names what must not be empty for it, and ``otherwise`` stands in its place. ``said`` stands
    between a role and its text, ``asked`` after a role without text. ``ends`` close the turns at even and odd places.
    """

    head: str
    said: str
    asked: str
    ends: tuple[str, str]
    if_any: str = ""
    otherwise: str = ""
    one_line_feed: bool = False
    rounds: bool = False
    role_by_place: bool = False


# The separator styles.
STYLES = {
    "add_colon_single": Style("{system}{sep}", ": ", ":", ("{sep}", "{sep}")),
    "add_colon_two": Style("{system}{sep}", ": ", ":", ("{sep}", "{sep2}")),
    "add_colon_space_single": Style("{system}{sep}", ": ", ": ", ("{sep}", "{sep}")),
    "no_colon_single": Style("{system}", "", "", ("{sep}", "{sep}")),
    "no_colon_two": Style("{system}", "", "", ("{sep}", "{sep2}")),
    "add_new_line_single": Style("{system}{sep}", "\n", "\n", ("{sep}", "{sep}"), if_any="system"),
    "llama2": Style("{system}", " ", "", ("{sep}", "{sep2}"), if_any="message", otherwise="[INST] ", role_by_place=True),
    "chatglm": Style("{system}{sep}", "：", "：", ("{sep}", "{sep}"), if_any="system", rounds=True),
    "chatml": Style("{system}{sep}\n", "\n", "\n", ("{sep}\n", "{sep}\n"), if_any="system"),
    "chatintern": Style("{system}", ":", ":", ("{sep}\n", "{sep2}\n")),
    "dolly": Style("{system}", ":\n", ":\n", ("{sep}", "{sep2}\n\n")),
    "rwkv": Style("{system}", ": ", ":", ("\n\n", "\n\n"), one_line_feed=True),
    "phoenix": Style("{system}", ": <s>", ": <s>", ("</s>", "</s>")),
    "robin": Style("{system}{sep}", ":\n", ":\n", ("{sep}", "{sep}")),
    "falcon_chat": Style("{system}{sep}", ": ", ":", ("{sep}", "{sep}"), if_any="message"),
    "chatglm3": Style("{system}", "\n ", "", ("", ""), if_any="message"),
    "husky": Style("{message}{sep}", ": ", ":", ("{sep}", "{sep2}")),
    "husky_n": Style("{message}{sep}", ": \n", ": \n", ("{sep}", "{sep2}")),
    "internlm2_chat": Style("{message}", "", "", ("{sep}", "{sep2}")),
    "mpt": Style("{system}{sep}", "", "", ("{sep}", "{sep}")),
}


@dataclass(frozen=True)
class Template:
    """A named way to write a conversation: a style with its separators, the system message and two roles."""

    name: str
    style: str
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    sep: str = "\n"
    sep2: str = ""
    message: str = ""
    system: str = "{system_message}"
    first_round: int = 0

    def __post_init__(self) -> None:
        if self.style not in STYLES:
            raise ValueError(f"no style {self.style}")

    def filled(self, form: str) -> str:
        system = self.system.replace("{system_message}", self.message)
        return form.replace("{system}", system).replace("{message}", self.message).replace("{sep2}", self.sep2).replace("{sep}", self.sep)


_TEMPLATES: dict[str, Template] = {}


def register(template: Template, override: bool = False) -> None:
    """Make a template known by its name; a known name is replaced only if asked for."""
    if template.name in _TEMPLATES and not override:
        raise ValueError(f"{template.name} is registered already")
    _TEMPLATES[template.name] = template


def template(name: str, message: str | None = None) -> Template:
    """The template of that name, with another system message if given."""
    found = _TEMPLATES[name]
    return found if message is None else replace(found, message=message)


# Templates of common chat formats.
register(Template("raw", "no_colon_single", ("", ""), sep=""))
register(Template("one_shot", "add_colon_single", ("Human", "Assistant"), sep="\n### "))
register(Template("vicuna_v1.1", "add_colon_two", sep=" ", sep2="</s>", message="A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."))
register(Template("llama-2", "llama2", ("[INST]", "[/INST]"), sep=" ", sep2=" </s><s>", system="[INST] <<SYS>>\n{system_message}\n<</SYS>>\n\n"))
register(Template("chatml", "chatml", ("<|im_start|>user", "<|im_start|>assistant"), sep="<|im_end|>", system="<|im_start|>system\n{system_message}"))
register(Template("chatglm", "chatglm", ("问", "答"), sep="\n"))
register(Template("chatglm2", "chatglm", ("问", "答"), sep="\n\n", first_round=1))
register(Template("mpt-chat", "mpt", ("<|im_start|>user\n", "<|im_start|>assistant\n"), sep="<|im_end|>", system="<|im_start|>system\n{system_message}"))


def prompt(turns: Column, t: Template, roles: tuple[str, str] | None = None) -> Column:
    """The conversation as one string. Roles are the turns' own, or ``roles`` by place if given."""
    style, by_place = STYLES[t.style], roles or (t.roles if STYLES[t.style].role_by_place else None)
    needed = {"": "x", "system": t.filled("{system}"), "message": t.message}[style.if_any]
    head = t.filled(style.head) if needed else style.otherwise
    even = lambda i: i % 2 == 0

    def written(turn: Column, i: Column) -> Column:
        role = F.when(even(i), by_place[0]).otherwise(by_place[1]) if by_place else turn["role"]
        text = F.replace(F.replace(turn["text"], F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n")) if style.one_line_feed else turn["text"]
        said = F.concat(role, F.lit(t.filled(style.said)), text, F.when(even(i), t.filled(style.ends[0])).otherwise(t.filled(style.ends[1])))
        if t.style == "llama2":  # the head has opened the first turn
            said = F.when(i == 0, F.concat(text, F.lit(" "))).otherwise(said)
        line = F.when(F.coalesce(F.length(turn["text"]), F.lit(0)) > 0, said).otherwise(F.concat(role, F.lit(t.filled(style.asked))))
        if style.rounds:
            line = F.concat(F.when(even(i), F.concat(F.lit("[Round "), F.floor(i / 2) + t.first_round, F.lit(f"]{t.sep}"))).otherwise(""), line)
        return line

    return F.concat(F.lit(head), F.array_join(F.transform(turns, written), ""))


@dataclass(frozen=True)
class Task:
    """Wording of a few-shot task: the line above the examples, forms of an example and of the question, and the answer's cue."""

    examples: str
    example: tuple[str, str]
    question: tuple[str, str]
    cue: str


# How captions and answers are asked for.
ASK_CAPTION = "Provide a one-sentence caption for the provided image."
CAPTION = Task("Here are some caption examples:\n", ("", "Caption: "), ("", ASK_CAPTION), "Caption: ")
ANSWER = Task("Here is a collation of question and answer examples:\n", ("Question: ", "\nAnswer: "), ("Question: ", "\n"), "Answer: ")
REFER = "Refer to these examples to perform the following task:\n"
IMAGE_MARKS = ("<img>", "<IMG_CONTEXT>", "</img>")


def image_block(patches: Column, per_patch: int = 256) -> Column:
    """The marks that stand for an image of so many patches."""
    return F.concat(F.lit(IMAGE_MARKS[0]), F.repeat(F.lit(IMAGE_MARKS[1]), (patches * per_patch).cast("int")), F.lit(IMAGE_MARKS[2]))


def few_shot_turns(demos: Column, question: Column, patches: Column, instruction: str, roles: tuple[str, str], task: Task = ANSWER, style: str = "multi", per_patch: int = 256, images: bool = True) -> Column:
    """Turns of a few-shot chat over ``demos``, an array of (question, answer, patches).

    multi: a round for each example, then the question; single: everything in one turn. ``images`` is false where the
    examples are shown without theirs. The last turn has no text. Captions ignore questions and instruction, and are trimmed.
    """
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.cast("string").alias("text"))
    caption = task is CAPTION
    if style == "multi":
        shown = lambda d: F.concat(image_block(d["patches"], per_patch), F.lit("\n")) if images else F.lit("")
        ask = lambda q: F.lit(ASK_CAPTION) if caption else F.concat(q, F.lit("\n" + instruction))
        answer = lambda d: F.trim(d["answer"]) if caption else d["answer"]
        rounds = F.flatten(F.transform(demos, lambda d: F.array(turn(roles[0], F.concat(shown(d), ask(d["question"]))), turn(roles[1], answer(d)))))
        last = F.concat(image_block(patches, per_patch), F.lit("\n"), ask(question))
        return F.concat(rounds, F.array(turn(roles[0], last), turn(roles[1], F.lit(None))))
    return F.array(turn(roles[0], one_turn(demos, question, patches, instruction, task, per_patch, images)), turn(roles[1], F.lit(None)))


def one_turn(demos: Column, question: Column, patches: Column, instruction: str, task: Task = ANSWER, per_patch: int = 256, images: bool = True, direct: bool = False) -> Column:
    """Examples, numbered from 1, and the question in one text; ``direct`` ends it with the cue of the answer, for no chat."""
    caption = task is CAPTION

    def example(d: Column, i: Column) -> Column:
        image = F.concat(image_block(d["patches"], per_patch), F.lit("\n")) if images else F.lit("")
        asked = F.lit("") if caption else d["question"]
        answer = F.trim(d["answer"]) if caption else d["answer"]
        return F.concat(F.lit("Example "), i + 1, F.lit(":\n"), image, F.lit(task.example[0]), asked, F.lit(task.example[1]), answer, F.lit("\n"))

    shots = F.when(F.size(demos) > 0, F.concat(F.lit(task.examples), F.array_join(F.transform(demos, example), ""), F.lit(REFER))).otherwise("")
    asked = F.lit(task.question[1]) if caption else F.concat(F.lit(task.question[0]), question, F.lit(task.question[1] + instruction))
    return F.concat(shots, image_block(patches, per_patch), F.lit("\n"), asked, F.lit(task.cue if direct else ""))
