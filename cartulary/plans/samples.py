"""Small sources for the parsing query."""

SAMPLES = {
    "src/auth.ts": '''import { Token } from './token';
export { helper } from "../util/helper";

/**
 * Checks a password.
 */
export async function authenticate(user: string, password: string): Promise<boolean> {
  if (!user) { return false; }
  for (const part of password.split(/[/]/)) {
    if (part === `${user}`) return true;
  }
  return user ? true : false;
}

const add = (a: number, b = 1): number => a + b;

export class Session extends Base implements Closable {
  private id: string = 'x';
  constructor(id: string) { super(); }
  async refresh({ force }: { force: boolean }): Promise<void> {
    while (force) { break; }
  }
  close() {}
}

export interface Options { name: string; limit?: number; run(): void }
export type Id = string | number;
export enum Role { Admin, User = 2 }
''',
    "lib/animals.py": '''from dataclasses import dataclass


def speak(name: str, times: int) -> str:
    """Says it."""
    for _ in range(times):
        if name:
            return name


async def fetch(url):
    return url


class Dog(Animal, Loud):
    def bark(self):
        pass


@dataclass
class Point:
    x: int
''',
    "cmd/main.go": '''package main

// User of the system.
type User struct {
	ID int
	Name string
}

type Store interface {
	Get(id int) User
}

type Alias = int

// NewUser makes one.
func NewUser(name string) (User, error) {
	if name == "" {
		return User{}, nil
	}
	return User{Name: name}, nil
}

func (u *User) rename(name string) {
	u.Name = name
}
''',
    "src/calc.rs": '''/// Adds.
pub fn add(a: i32, b: i32) -> i32 {
    a + b
}

pub struct Calculator {
    pub value: i32,
    name: String,
}

impl Calculator {
    pub async fn run(&self) -> i32 {
        if self.value > 0 { 1 } else { 0 }
    }
}

enum Kind {
    One,
    Two,
}

trait Shape {
    fn area(&self) -> f64;
}
''',
}
